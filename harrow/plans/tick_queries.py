"""Queries over a whole tick: from responses to run rows, records, events, repairs and states."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gate as G
from ..operators import health as H
from ..operators import tick as K
from .health_queries import NULLS, REPORT, VERDICT
from .registry import Tables, query
from .web_queries import _JP, SCHEMA

AT = datetime(2024, 2, 1)
REQUIRED = ("id", "title")

RUNS = f"""select id, source_id, canary, tier, fetch_ms, bytes, n, variant, fetched, case when fetched <> 'ok' then fetched when variant >= 3 or n = 0 then 'empty' when n = 3 then 'schema_invalid' else 'ok' end as outcome,
 case when fetched <> 'ok' or variant >= 3 then 0 else n end as items, case when fetched <> 'ok' or variant >= 3 then 0 else least(n, 2) end as valid_items from (select *, {_JP} else 'ok' end as fetched from {{tick_responses}}) r"""


@query(f"""select id, source_id, outcome, items, valid_items, outcome = 'ok' as complete, tier, fetch_ms, bytes,
 case when fetched <> 'ok' then null when items = 0 then 'id=1000000 title=1000000' when n = 3 then 'id=333333 points=0 title=0' else 'id=0 points=0 title=0' end as nulls from ({RUNS}) r""")
def run_rows(t: Tables) -> DataFrame:
    """The run row of every response, with null rates of all its items, tier and timings."""
    runs = G.process(t.tick_responses, SCHEMA, keep=("source_id", "tier", "fetch_ms", "bytes"), required=REQUIRED)[0]
    shown = F.transform(F.array_sort(F.map_entries("field_nulls")), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1_000_000).cast("long").cast("string")))
    return runs.select("id", "source_id", "outcome", "items", "valid_items", "complete", "tier", "fetch_ms", "bytes", F.when(F.col("field_nulls").isNotNull(), F.array_join(shown, " ")).alias("nulls"))


CHANGES = f"""with r as ({RUNS}), w as (select r.* from r join {{tick_sources}} s on s.source_id = r.source_id where not canary and state = 'active'),
i as (select source_id, id, concat(id, '1') as external_key, concat('{{{{"id":"', id, '1","points":', id, ',"title":"a"}}}}') as payload from w where valid_items >= 1 union all select source_id, id, concat(id, '2'), concat('{{{{"id":"', id, '2","points":2,"title":"b"}}}}') from w where valid_items >= 2),
e as (select i.source_id, i.external_key, case when c.payload is null then 'insert' when c.payload = i.payload and c.is_active then 'unchanged' else 'update' end as kind from i left join {{tick_records}} c on c.source_id = i.source_id and c.external_key = i.external_key),
g as (select c.source_id, c.external_key, 'gone' as kind from {{tick_records}} c where is_active and source_id in (select source_id from w group by source_id having bool_and(outcome = 'ok')) and source_id in (select source_id from i)
  and not exists (select 1 from i where i.source_id = c.source_id and i.external_key = c.external_key)),
x as (select * from e where kind <> 'unchanged' union all select * from g)"""


def _tick(t: Tables) -> K.Tick:
    records = t.tick_records.withColumn("content_hash", F.sha2("payload", 256))
    return K.run_tick(t.tick_responses, t.tick_sources, records, SCHEMA, REQUIRED, AT)


@query(f"{CHANGES} select source_id, external_key, kind from x")
def tick_changes(t: Tables) -> DataFrame:
    """What a tick changes: nothing of stopped sources or canaries, and what complete sources have lost."""
    return _tick(t).events


@query(f"""{CHANGES}, k as (select coalesce(c.source_id, i.source_id) as source_id, coalesce(c.external_key, i.external_key) as external_key, coalesce(i.payload, c.payload) as payload, i.external_key is not null as came, c.is_active
 from {{tick_records}} c full outer join i on i.source_id = c.source_id and i.external_key = c.external_key)
select k.source_id, k.external_key, payload, (came or is_active) and g.kind is null as is_active, case when g.kind is not null then timestamp '2024-02-01 00:00:00' end as gone_at from k left join g on g.source_id = k.source_id and g.external_key = k.external_key""")
def tick_records_after(t: Tables) -> DataFrame:
    """The records after a tick."""
    return _tick(t).written.select("source_id", "external_key", "payload", "is_active", "gone_at")


@query(f"""{CHANGES} select (select count(*) from r) as jobs, (select count(*) from r where outcome not in ('ok', 'schema_invalid')) as failed, (select cast(sum(items) as bigint) from r) as items, (select cast(sum(valid_items) as bigint) from r) as valid_items,
 (select count(*) from x where kind <> 'gone') as written, (select count(*) from x where kind = 'gone') as swept""")
def tick_summary(t: Tables) -> DataFrame:
    """The tick's figures: those of the runs are observed while they are written, without another scan."""
    return _tick(t).summary


FIXTURES = "select event_id as id, user_id as source_id, ts as captured_at from {events} where event_type = 'view' or event_id % 3 = 0"
ACTIVE = "select event_id % 97 as source_id, max(event_id) as id from {events} group by 1"


@query(f"""with rep as ({REPORT}), o as (select distinct source_id from {{repairs}} where state in ('queued', 'running')), f as (select source_id, count(*) as failed from {{repairs}} where kind = 'repair' and state = 'failed' group by source_id),
q as (select rep.* from rep join {{sources}} s on s.source_id = rep.source_id left join o on o.source_id = rep.source_id left join f on f.source_id = rep.source_id where (trip_schema or trip_null or trip_yield or trip_streak) and s.state = 'active' and o.source_id is null and coalesce(failed, 0) < 3),
n as (select *, row_number() over (partition by source_id order by captured_at desc, id desc) as rn from ({FIXTURES}) x),
c as (select source_id, list(cast(id as varchar) order by rn) as corpus from n where rn <= 6 group by source_id),
a as ({ACTIVE}), l as (select user_id as source_id, cast(max(event_id) as varchar) as fresh from {{events}} where event_id % 4 = 0 group by 1)
select q.source_id, 'repair' as kind, array_to_string(list_filter([case when trip_schema then 'schema-invalid-rate' end, case when null_rate_price > 0.15 then 'required-field-null-rate price' end, case when null_rate_title > 0.15 then 'required-field-null-rate title' end, case when trip_yield then 'item-yield-collapse' end, case when trip_streak then 'consecutive-failures' end], lambda x: x is not null), '; ') as trips,
 array_to_string(list_filter([case when null_rate_price > 0.15 then 'price' end, case when null_rate_title > 0.15 then 'title' end], lambda x: x is not null), '; ') as failing_fields, schema_invalid_rate, median_items, latest_items, blocked, a.id as prior_adapter_id,
 array_to_string(list_concat(case when fresh is null then [] else [fresh] end, list_filter(coalesce(corpus, []), lambda x: fresh is null or x <> fresh)), ',') as fixture_ids
from q left join c on c.source_id = q.source_id left join a on a.source_id = q.source_id left join l on l.source_id = q.source_id""")
def repair_requests(t: Tables) -> DataFrame:
    """The repairs that a tick asks for: what tripped, failing fields, the adapter, the fresh page and six more."""
    report = H.health_report(t.runs, NULLS)
    e = t.events
    fixtures = e.where("event_type = 'view' or event_id % 3 = 0").select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), F.col("ts").alias("captured_at"))
    adapters = e.groupBy((F.col("event_id") % 97).alias("source_id")).agg(F.max("event_id").alias("id")).withColumn("status", F.lit("active"))
    fresh = e.where("event_id % 4 = 0").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("id"))
    r = K.repair_requests(report, H.health_action(report, t.sources, t.repairs), fixtures, adapters, fresh, {f: f"null_rate_{f}" for f in NULLS})
    return r.withColumns({"trips": F.array_join("trips", "; "), "failing_fields": F.array_join("failing_fields", "; "), "fixture_ids": F.array_join("fixture_ids", ",")})


@query(f"""with v as ({VERDICT}), a as (select user_id * 10 + s as id, user_id as source_id, s as version, case s when 1 then 'retired' when 2 then 'active' else 'canary' end as status from (select distinct user_id from {{events}}) u cross join (values (1), (2), (3)) z(s))
select a.id, a.source_id, a.version, case when v.verdict = 'promote' and status = 'canary' then 'active' when v.verdict = 'promote' and status = 'active' then 'retired' when v.verdict = 'reject' and status = 'canary' then 'rejected' else status end as status from a left join v on v.source_id = a.source_id""")
def canary_applied(t: Tables) -> DataFrame:
    """Adapters after their canaries' verdicts."""
    return _judged(t)[0].select("id", "source_id", "version", "status")


@query(f"""with v as ({VERDICT}) select s.source_id, case when v.verdict = 'promote' then 'active' else s.state end as state from {{sources}} s left join v on v.source_id = s.source_id""")
def source_states_after_canary(t: Tables) -> DataFrame:
    """Sources after their canaries' verdicts: with a promoted one they are active again."""
    return _judged(t)[1].select("source_id", "state")


def _judged(t: Tables) -> tuple[DataFrame, DataFrame]:
    u = t.events.select(F.col("user_id").alias("source_id")).distinct()
    a = u.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select((F.col("source_id") * 10 + F.col("version")).alias("id"), "source_id", "version", F.element_at(F.array(F.lit("retired"), F.lit("active"), F.lit("canary")), F.col("version")).alias("status"))
    return K.judged(a, H.canary_verdict(t.arm_runs), t.sources)
