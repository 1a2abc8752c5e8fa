"""The domain's tables as views over the driver's star schema, in SQL that Spark and DuckDB both read.

``{name}`` stands for another table or view; ``$K`` for the integer k of an event's JSON properties.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "runs": """
select event_id as id, user_id as source_id, ts as created_at, outcome, canary, items,
  case when outcome = 'schema_invalid' then items - cast(floor(items * (k + 1) / 100.0) as int) else items end as valid_items,
  case when items = 0 then null when m = 4 then 0.30 else k / 1000.0 end as null_price,
  case when items = 0 then null else (k % 7) / 100.0 end as null_title, attempt, tier
from (select *, case when outcome in ('ok', 'schema_invalid') then 20 + cast(floor(value / 50) as int) else 0 end as items
  from (select event_id, user_id, ts, value, k, user_id % 10 as m, (event_id % 100) < 10 as canary, cast(event_id % 4 as int) as attempt,
      case when event_id % 5 = 0 then 'browser' else 'http' end as tier,
      case when user_id % 10 = 7 and ts >= timestamp '2024-01-20 00:00:00' then case when k % 2 = 0 then 'empty' else 'exec_error' end
           when user_id % 10 = 3 then 'schema_invalid'
           when event_type = 'error' and k < 5 then 'fetch_error'
           when event_type = 'error' and k < 10 then 'timeout'
           when event_type = 'signup' and k < 30 then 'blocked'
           when event_type = 'click' and k < 40 then 'schema_invalid'
           else 'ok' end as outcome
    from (select *, cast($K as int) as k from {events}) e0) e1) e2""",
    "arm_runs": """
select id, source_id, outcome, items, valid_items, case when source_id % 9 = 0 then id % 4 = 0 else id % 2 = 0 end as canary from {runs}""",
    "sources": """
select source_id, cast(1 + source_id % 3 as int) as cadence_days, concat('source-', cast(source_id as varchar(20))) as source_key,
  case when source_id % 5 = 3 then 'degraded' when source_id % 5 = 4 then 'repairing' else 'active' end as state,
  case when source_id % 7 = 0 then null else concat('https://', cast(source_id % 11 as varchar(20)), '.example.com/list?q={{key}}') end as template,
  cast(source_id % 4 as int) as n_keys, updated_at
from (select user_id as source_id, max(ts) as updated_at from {events} group by user_id) s""",
    "spans": """
select id, user_id as source_id, ts as moment, case v when 0 then '1 day' when 1 then '1 mon 2 days' when 2 then concat(ks, ':30:00') when 3 then concat(ks, ' days -01:15:30') when 4 then '2 weeks' when 5 then concat('-1 days +', ks, ':00:00') when 6 then concat(ks, ' hours') when 7 then '1 year 3 mons' when 8 then concat(ks, ' minutes') else '00:00:05.25' end as span
from (select event_id as id, user_id, ts, cast(event_id % 10 as int) as v, cast(1 + cast($K as int) as varchar(20)) as ks from {events}) e""",
    "jobs": """
select o_orderkey as id, o_custkey as source_id, cast(substring(o_orderpriority, 1, 1) as int) * 50 as priority,
  case o_orderstatus when 'P' then 'queued' when 'O' then 'running' else 'done' end as state,
  cast(o_orderkey % 7 as int) as attempts, o_orderdate as run_after, case when o_orderstatus in ('P', 'O') then o_orderdate end as locked_at,
  concat('https://x.example/o/', cast(o_orderkey as varchar(20))) as url, concat('o', cast(o_orderkey as varchar(20))) as external_key,
  case when o_orderstatus = 'O' then 'w1' end as locked_by, case when o_orderkey % 3 = 0 then 'timeout' end as last_error
from {orders}""",
    "adapters": """
select id, source_id, version, case when rnk = 1 then 'canary' when rnk = 2 then 'active' when size2 = 0 then 'retired' else 'draft' end as status
from (select p_partkey as id, p_brand as source_id, p_size % 2 as size2,
    cast(row_number() over (partition by p_brand order by p_partkey) as int) as version,
    row_number() over (partition by p_brand order by p_partkey desc) as rnk from {part}) p""",
    "line_items": """
select l_orderkey % 50 as source_id, concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20))) as external_key,
  cast(l_quantity as int) as quantity, l_shipdate as seen_at, l_partkey as job_id, l_suppkey as item_idx, l_linestatus,
  concat('q', cast(cast(l_quantity as int) as varchar(20)), 'p', cast(l_partkey % 5 as varchar(20))) as content_hash,
  concat('{{"q":', cast(cast(l_quantity as int) as varchar(20)), ',"p":', cast(l_partkey % 5 as varchar(20)), '}}') as payload
from {lineitem}""",
    "record_cur": """
select source_id, external_key, payload, content_hash, seen_at - interval '10' day as first_seen, seen_at as last_seen, job_id as last_run_id, quantity % 7 <> 0 as is_active, case when quantity % 7 = 0 then seen_at end as gone_at
from (select *, row_number() over (partition by source_id, external_key order by seen_at desc, job_id desc, item_idx desc, content_hash desc) as rnk from {line_items} where l_linestatus = 'O') c where rnk = 1""",
    "incoming": """
select source_id, external_key, payload, content_hash, seen_at, job_id, item_idx, job_id as run_id from {line_items} where l_linestatus = 'F'""",
    "rich_pages": """
select page_id, replace(html, '</head>', concat(case when page_id % 3 = 0 then concat('<script type="application/ld+json">{{"@type": "Thing",', chr(10), ' "n": ', cast(page_id as varchar(20)), '}}</script>')
  when page_id % 3 = 1 then concat('<script>', chr(10), ' window.__STATE__ = {{"items": [', cast(page_id as varchar(20)), '], "text": "', repeat('x y ', cast(page_id % 300 as int)), '"}}</script><script>self.__x=1</script>') else '' end,
  case when page_id % 2 = 0 then '<script id="__NEXT_DATA__" type="application/json">{{}}</script>' else '' end, '</head>')) as html from {pages}""",
    "responses": """
select page_id, url, status, content_type, case variant when 1 then concat('<title>Just a moment</title>', html) when 2 then replace(html, '<article', '<section')
  when 3 then substring(html, 1, 300) when 4 then concat('{{"items":[', cast(page_id as varchar(20)), ']}}') else html end as body
from (select page_id, url, html, cast(page_id % 5 as int) as variant, case cast(page_id % 7 as int) when 1 then 403 when 2 then 404 when 3 then 503 when 4 then 429 else 200 end as status,
    case when page_id % 5 = 4 and page_id % 2 = 0 then 'application/json' when page_id % 3 = 0 then 'text/html' else '' end as content_type from {pages}) p""",
    "payloads": """
select id, source_id, fixture, v, k, case v
  when 0 then concat('{{"title":"t', ks, '","id":"123","url":null,"points":', ks, '}}')
  when 1 then concat('{{"id":"9", "title":"t","points":', ks, '}}')
  when 2 then '{{"id":"a1","title":"t","points":1}}'
  when 3 then '{{"points":-1,"id":"7","title":""}}'
  when 4 then '{{"id":7,"title":"t","points":1.5}}'
  when 5 then '{{"title":"t","points":2,"extra":{{"z":1,"b":[3,1]}}}}'
  when 6 then '{{"id":"8","title":null,"points":3,"url":"u"}}'
  when 7 then '[1,2]'
  when 8 then '{{"id":"12","title":"e","points":1e2}}'
  when 9 then '{{"points":100.0,"title":"e","id":"12"}}'
  when 10 then concat('{{"id":"', ks, '","title":"no 1.0 here","points":', ks, '.50,"na me":true,"0":{{"y":[],"x":-0.0}}}}')
  when 11 then concat('{{"title":"x","id":"', ks, '","points":0.0,"url":"u","key":', ks, '.0}}')
  when 12 then 'not json'
  else concat('{{"externalKey":"e', ks, '","id":"', ks, '","title":"t', ks, '","points":', ks, '}}') end as payload
from (select event_id as id, user_id as source_id, cast(event_id % case when user_id % 5 = 1 then 2 else 4 end + 4 * cast(floor(event_id / 100000) as int) as int) as fixture, cast(event_id % 14 as int) as v, cast($K as int) as k, cast(cast($K as int) as varchar(20)) as ks from {events}) e""",
    "bodies": """
select id, case v when 0 then concat('{{"a":', ks, '}}') when 1 then concat('{{"a":', ks, '}} {{"b":2}}') when 2 then concat('[', ks, '] [2]') when 3 then concat('{{"a":', ks, '}} x}}') when 4 then concat('{{"a":1,"a":', ks, '}}')
  when 5 then concat('{{"a":', ks, '}}]') when 6 then concat('{{"a":"it''s ', ks, '"}}') when 7 then concat(' [', ks, ',{{"b":"}}]"}}]') when 8 then concat('{{''a'':', ks, '}}') when 9 then concat('[', ks, ',]') when 10 then ks else concat('{{"a":0', ks, '}}') end as body
from (select event_id as id, cast(event_id % 12 as int) as v, cast(cast($K as int) as varchar(20)) as ks from {events}) e""",
    "forms": """
select id, concat('{{"kind":', case when v % 3 = 0 then '"card"' when v % 3 = 1 then '"bank"' else 'null' end, case when v % 2 = 0 then concat(',"number":"', ks, '"') else '' end, case when v % 5 < 2 then ',"address":"a"' else '' end,
  case when v % 4 = 1 then concat(',"iban":"', ks, '"') else '' end, case when v % 7 = 0 then concat(',"N', ks, '":1') else '' end, case when v % 11 = 3 then '' else concat(',"tags":["t",', case when k % 3 = 0 then '"x"' else ks end, case when k % 5 = 0 then '' when k % 5 = 1 then ',true' when k % 5 = 2 then ',false' else ',true,1' end, ']') end, '}}') as payload
from (select event_id as id, cast(event_id % 60 as int) as v, cast($K as int) as k, cast(cast($K as int) as varchar(20)) as ks from {events}) e""",
    "trees": """
select id, concat(repeat(concat('{{"id":', ks, ',"kids":['), d), case v when 0 then '{{"id":1}}' when 1 then '{{"id":-1}}' when 2 then '{{"kids":[]}},{{"id":2,"note":"n"}}' when 3 then '"x"' when 4 then '{{"id":7}},{{"id":7,"note":"n","kids":[{{"id":2.5}}]}}' else '' end, repeat(']}}', d), case when d = 0 and (v = 2 or v >= 4) then ' 1' else '' end) as payload
from (select event_id as id, cast(event_id % 7 as int) as d, cast($K as int) % 6 as v, cast(cast($K as int) as varchar(20)) as ks from {events}) e""",
    "gate_items": """
select id, source_id, fixture, case when source_id % 3 = 0 then concat('{{"id":"', cast(k as varchar(20)), '","title":"t","points":', cast(id as varchar(20)), '}}') else payload end as payload from {payloads}""",
    "json_pages": """
select page_id as id, status, content_type, case when variant = 3 then '{{"items":"none"}}' when variant = 4 then html else concat('{{"items":[', case when n >= 1 then concat('{{"id":"', p, '1","title":"a","points":', p, '}}') else '' end,
    case when n >= 2 then concat(',{{"id":"', p, '2","title":"b","points":2}}') else '' end, case when n >= 3 then ',{{"title":"c","points":-2}}' else '' end, ']}}') end as body, n, variant
from (select page_id, html, cast(page_id as varchar(20)) as p, cast(page_id % 4 as int) as n, cast(page_id % 5 as int) as variant, case cast(page_id % 7 as int) when 1 then 403 when 2 then 404 when 3 then 503 when 4 then 429 else 200 end as status,
    case when page_id % 2 = 0 then 'application/json' else '' end as content_type from {pages}) x""",
    "tick_responses": """
select id, id - id % 2 as source_id, id % 10 = 0 as canary, status, content_type, body, case when id % 5 = 0 then 'browser' else 'http' end as tier, id % 900 as fetch_ms, length(body) as bytes, n, variant from {json_pages}""",
    "tick_sources": """
select source_id, case when source_id % 7 = 2 then 'degraded' when source_id % 7 = 5 then 'disabled' else 'active' end as state from (select distinct id - id % 2 as source_id from {json_pages}) s""",
    "tick_records": """
select source_id, external_key, payload, active as is_active, timestamp '2024-01-01 00:00:00' as first_seen, timestamp '2024-01-02 00:00:00' as last_seen
from (select id - id % 2 as source_id, concat(cast(id as varchar(20)), '1') as external_key, concat('{{"id":"', cast(id as varchar(20)), '1","points":', cast(id as varchar(20)), ',"title":"', case when id % 4 = 1 then 'old' else 'a' end, '"}}') as payload, id % 11 <> 0 as active from {json_pages} where id % 3 <> 0
  union all select id - id % 2, concat('x', cast(id as varchar(20))), '{{}}', id % 6 <> 0 from {json_pages} where id % 2 = 1) r""",
    "listings": """
select page_id, concat('<html><body><div class="list">',
  '<a data-testid="search-result-entry-header-', p, '" href="/d/', p, '"><h3> Flat ', p, ' </h3><span aria-label="Ort ', p, '">', plz, ' Wien, ', p, '. Bezirk, Nord</span>',
  '<div data-testid="search-result-entry-teaser-attributes-', p, '"><span>', p, ',5 m²</span><span>3 Zimmer</span><span>Balkon</span></div>',
  '<span data-testid="search-result-entry-price-', p, '">€ ', p, '.450,00</span><img alt="Cover Image" src="/i/', p, '.jpg"></a>',
  '<a data-testid="search-result-entry-header-ad" href="/ad"><h3>Ad</h3></a>',
  '<a data-testid="search-result-entry-header-9', p, '" href="https://x.example/', p, '"><h3>Loft</h3><span data-testid="search-result-entry-price-9', p, '">Preis auf Anfrage</span></a>',
  '</div><a data-testid="pagination-bottom-next-button" href="/p/2"', case when page_id % 2 = 0 then ' aria-disabled="true"' else '' end, '>next</a></body></html>') as html
from (select page_id, cast(page_id + 1 as varchar(20)) as p, cast(1000 + page_id % 230 as varchar(20)) as plz from {pages}) x""",
    "texts": """
select event_id as id, concat(case when k % 3 = 0 then '€ ' else '' end, cast(k as varchar(20)), '.', lpad(cast(event_id % 1000 as varchar(20)), 3, '0'), case when k % 2 = 0 then ',50' else '' end, case when k % 7 = 0 then ' pro Monat' else '' end) as price,
  concat(cast(1000 + k as varchar(20)), ' Wien', case when k % 4 <> 0 then concat(', ', cast(k as varchar(20)), '. Bezirk, ', event_type) else '' end) as address,
  case when k % 3 = 0 then concat(cast(k as varchar(20)), ',5 m²') when k % 3 = 1 then concat(cast(k as varchar(20)), ' Zimmer') else 'Balkon' end as teaser,
  case when k % 3 = 0 then concat('http://a.example/', cast(k as varchar(20))) when k % 3 = 1 then concat('/p/', cast(k as varchar(20))) else concat('q', cast(k as varchar(20))) end as href,
  concat(event_type, case when k % 2 = 0 then '-' else '_' end, cast(event_id as varchar(20))) as anchor,
  concat('  ', event_type, '   a', chr(9), 'b', chr(10), ' ', case when k % 2 = 0 then 'long ' else '' end, event_type, ' ') as messy,
  case cast(k % 6 as int) when 0 then 'div > ul > li' when 1 then '[data-list] > li' when 2 then 'a:nth-child(2)' when 3 then 'div.x, main > * > p' when 4 then 'li:first-child' else 'ul > li.a > b' end as selector
from (select event_id, event_type, cast($K as int) as k from {events}) e""",
    "repairs": """
select conv_id as id, conv_id % 40 as source_id, case when conv_id % 3 = 0 then 'compile' else 'repair' end as kind,
  case cast(conv_id % 4 as int) when 0 then 'queued' when 1 then 'failed' when 2 then 'succeeded' else 'running' end as state, cast(turns as int) as turns
from (select conv_id, count(*) as turns from {conversations} group by conv_id) c""",
}


def _fill(sql: str, k: str) -> str:
    return sql.replace("$K", k)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or view as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _fill(VIEWS[name], "get_json_object(props, '$.k')")
    return spark.sql(sql, **{n: frame(spark, sf_dir, n) for n in dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql))})


def _needs(sql: str) -> list[str]:
    out: list[str] = []
    for n in re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql):
        if n in VIEWS:
            out += [*_needs(VIEWS[n]), n]
    return list(dict.fromkeys(out))


def duck(sql: str) -> str:
    """DuckDB's SQL for a query over ``{view}`` names, the views it needs put in front."""
    shown = lambda s: re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", _fill(s, "json_extract_string(props, '$.k')")).replace("{{", "{").replace("}}", "}")
    names = _needs(sql)
    ctes = ", ".join(f"{n} as materialized ({shown(VIEWS[n])})" for n in names)
    body = shown(sql).strip()
    if not names:
        return body
    own = re.match("with (recursive )?", body)
    return f"{own[0]}{ctes}, {body[own.end() :]}" if own else f"with {ctes} {body}"
