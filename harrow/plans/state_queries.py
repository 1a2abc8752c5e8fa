"""Queries over records, jobs and adapters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compile as C
from ..operators import lifecycle as L
from ..operators import queue as Q
from ..operators import upsert as U
from .registry import Tables, query

AS_OF = datetime(2024, 1, 31)
JOBS_AS_OF = datetime(1998, 1, 1)
TICK = datetime(2024, 1, 30)

TRANS = """
select source_id, external_key, seen_at, job_id, item_idx, content_hash,
  case when first and cur_hash is null then 'insert' when first and cur_hash = content_hash and cur_active then 'unchanged' when not first and before = content_hash then 'unchanged' else 'update' end as kind
from (select i.*, c.content_hash as cur_hash, c.is_active as cur_active,
    row_number() over (partition by i.source_id, i.external_key order by i.seen_at, i.job_id, i.item_idx, i.content_hash) = 1 as first,
    lag(i.content_hash) over (partition by i.source_id, i.external_key order by i.seen_at, i.job_id, i.item_idx, i.content_hash) as before
  from {incoming} i left join {record_cur} c on c.source_id = i.source_id and c.external_key = i.external_key) x"""


@query(TRANS)
def upsert_intra_batch(t: Tables) -> DataFrame:
    return U.transitions(t.record_cur, t.incoming)


#: A record's id in DuckDB, and its columns as they are carried.
ID = "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))"
WITH_ID = f"(select * exclude (h), {ID} as rid from (select *, sha256(concat(cast(source_id as varchar), chr(0), external_key)) as h from {{0}}))"


def _records(t: Tables) -> DataFrame:
    return t.record_cur.withColumn("id", U.record_id(F.col("source_id"), F.col("external_key")))


@query(f"select * from ({TRANS}) k where kind <> 'unchanged'")
def change_events(t: Tables) -> DataFrame:
    return U.change_events(t.record_cur, t.incoming)


@query(f"""select 1000 + row_number() over (order by seen_at, job_id, item_idx, content_hash, source_id, external_key) as id, rid as record_id, source_id, external_key, kind, seen_at as created_at, cast(null as timestamp) as consumed_at
from {WITH_ID.replace("{0}", f"({TRANS}) k")} x where kind <> 'unchanged'""")
def change_feed(t: Tables) -> DataFrame:
    """The batch's changes as they are appended to the feed, after the thousand events that are there."""
    return U.feed(U.change_events(t.record_cur, t.incoming), F.col("seen_at"), [*U.ORDER, *U.KEY], 1000)


@query(f"""select source_id, cast(count(*) filter (kind = 'insert') as bigint) as inserted, cast(count(*) filter (kind = 'update') as bigint) as updated, cast(count(*) filter (kind = 'unchanged') as bigint) as unchanged from ({TRANS}) k group by source_id""")
def write_result(t: Tables) -> DataFrame:
    return U.write_result(t.record_cur, t.incoming)


MERGED = f"""with l as (select source_id, external_key, content_hash as new_hash, payload as new_payload, run_id as new_run, seen_at as new_seen, new_first
  from (select *, row_number() over (partition by source_id, external_key order by seen_at desc, job_id desc, item_idx desc, content_hash desc) as rnk, min(seen_at) over (partition by source_id, external_key) as new_first from {{incoming}}) x where rnk = 1),
j as (select coalesce(c.source_id, l.source_id) as source_id, coalesce(c.external_key, l.external_key) as external_key, c.* exclude (source_id, external_key), l.* exclude (source_id, external_key),
    content_hash is null as fresh, new_hash is not null as came, new_hash is not null and (new_hash <> content_hash or not is_active) as changed
  from {{record_cur}} c full outer join l on l.source_id = c.source_id and l.external_key = c.external_key)
select rid as id, source_id, external_key, case when changed or fresh then new_payload else payload end as payload, coalesce(new_hash, content_hash) as content_hash, coalesce(first_seen, new_first) as first_seen,
  case when came then greatest(new_seen, coalesce(last_seen, new_seen)) else last_seen end as last_seen, case when came then new_run else last_run_id end as last_run_id, came or is_active as is_active,
  case when not came then gone_at end as gone_at, case when fresh then 'insert' when changed then 'update' else 'unchanged' end as change
from {WITH_ID.replace("{0}", "j")} x"""


@query(MERGED)
def upsert_merge(t: Tables) -> DataFrame:
    """Records after a batch, all columns."""
    return U.upsert(_records(t), t.incoming)


OUTBOX = "select event_id as id, user_id as source_id, event_type as kind, ts as created_at, case when event_id % 3 = 0 then ts end as consumed_at from {events}"


def _outbox(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), F.col("event_type").alias("kind"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("consumed_at"))


@query(f"select id, source_id, kind, created_at from ({OUTBOX}) o where consumed_at is null order by id limit 100")
def outbox_read(t: Tables) -> DataFrame:
    """The next page of the feed: a hundred events is what a consumer takes at a time."""
    return U.outbox_read(_outbox(t), 100).select("id", "source_id", "kind", "created_at")


@query(f"select id, coalesce(consumed_at, case when kind = 'click' then timestamp '2024-01-31 00:00:00' end) as consumed_at from ({OUTBOX}) o")
def mark_consumed(t: Tables) -> DataFrame:
    o = _outbox(t)
    at = U.mark_consumed(o.withColumn("consumed_at", F.col("consumed_at")), o.where("kind = 'click'").select("id"), AS_OF)
    return at.select("id", F.col("consumed_at").cast("timestamp_ntz").alias("consumed_at"))


COMPLETE = "select distinct source_id from {record_cur} where source_id % 3 <> 0"


@query(f"""select source_id, external_key, 'gone' as kind from {{record_cur}} c where is_active and source_id in ({COMPLETE}) and source_id in (select source_id from {{incoming}})
and not exists (select 1 from {{incoming}} i where i.source_id = c.source_id and i.external_key = c.external_key)""")
def sweep_absent(t: Tables) -> DataFrame:
    return U.sweep_absent(t.record_cur, t.incoming, t.record_cur.where("source_id % 3 <> 0").select("source_id").distinct())


SWEPT = f"""is_active and source_id in ({COMPLETE}) and source_id in (select source_id from {{incoming}}) and not exists (select 1 from {{incoming}} i where i.source_id = c.source_id and i.external_key = c.external_key)"""


@query(f"""select rid as id, source_id, external_key, payload, content_hash, first_seen, last_seen, last_run_id, is_active and not swept as is_active, case when swept then timestamp '1999-01-01 00:00:00' else gone_at end as gone_at
from {WITH_ID.replace("{0}", f"(select *, {SWEPT} as swept from {{record_cur}} c)")} x""")
def sweep_apply(t: Tables) -> DataFrame:
    """Records after a sweep: those it did not see are inactive, and gone since then."""
    gone = U.sweep_absent(t.record_cur, t.incoming, t.record_cur.where("source_id % 3 <> 0").select("source_id").distinct())
    return U.swept(_records(t), gone, F.lit(datetime(1999, 1, 1)).cast("timestamp_ntz")).select(*U.RECORD)


@query(f"""select row_number() over (order by source_id, external_key) as id, rid as record_id, source_id, external_key, 'gone' as kind, timestamp '1999-01-01 00:00:00' as created_at, cast(null as timestamp) as consumed_at
from {WITH_ID.replace("{0}", f"(select * from {{record_cur}} c where {SWEPT})")} x""")
def gone_feed(t: Tables) -> DataFrame:
    """The events of a sweep."""
    gone = U.sweep_absent(t.record_cur, t.incoming, t.record_cur.where("source_id % 3 <> 0").select("source_id").distinct())
    return U.feed(gone, F.lit(datetime(1999, 1, 1)).cast("timestamp_ntz"), U.KEY)


@query(f"""select source_id, external_key, last_seen, 'gone' as kind from {{record_cur}} where is_active and last_seen < timestamp '1997-06-01 00:00:00' and source_id in ({COMPLETE})""")
def sweep_stale(t: Tables) -> DataFrame:
    return U.sweep_stale(t.record_cur, datetime(1997, 6, 1), t.record_cur.where("source_id % 3 <> 0").select("source_id").distinct())


@query("""select source_id, cast(count(*) as bigint) as jobs from {runs} where created_at >= timestamp '2024-01-30 00:00:00' and source_id in (select source_id from {sources} where state = 'active')
group by source_id having bool_and(outcome = 'ok')""")
def sweep_sources(t: Tables) -> DataFrame:
    return U.sweep_sources(t.runs, t.sources, TICK)


DUE = """select * from {sources} s where state in ('active', 'repairing') and not exists (select 1 from {runs} r where r.source_id = s.source_id and r.created_at > timestamp '2024-01-31 00:00:00' - s.cadence_days * interval '1' day)"""


@query(f"select source_id, cadence_days, state from ({DUE}) d")
def due_sources(t: Tables) -> DataFrame:
    return Q.due_sources(t.sources, t.runs, AS_OF).select("source_id", "cadence_days", "state")


@query(f"select source_id, cadence_days, state, updated_at from ({DUE}) d order by updated_at, source_id limit 50")
def due_page(t: Tables) -> DataFrame:
    """The fifty due sources that have waited longest: what one tick takes."""
    return Q.due_sources(t.sources, t.runs, AS_OF, Q.DUE_PAGE).select("source_id", "cadence_days", "state", "updated_at")


@query("""select id, cast(datepart('year', i) * 12 + datepart('month', i) as int) as months, cast(datepart('day', i) as int) as days, cast(epoch(i - to_months(cast(datepart('year', i) * 12 + datepart('month', i) as int)) - to_days(cast(datepart('day', i) as int))) * 1000 as bigint) as millis, moment - i as before
from (select id, moment, cast(replace(span, '+', '') as interval) as i from {spans}) s""")
def cadence_spans(t: Tables) -> DataFrame:
    """Spans of time as text: their months, days and time, and a point in time less the span."""
    s = t.spans.withColumn("p", Q.interval_parts(F.col("span")))
    return s.select("id", "p.months", "p.days", (F.col("p.seconds") * 1000).cast("long").alias("millis"), Q.before(F.col("moment"), F.col("p")).alias("before"))


CADENCE = "case cast(source_id % 5 as int) when 0 then '1 day' when 1 then '1 mon' when 2 then '36:00:00' when 3 then '12 hours' else '1 week -1 days' end"


@query(f"""with s as (select *, {CADENCE} as cadence from {{sources}}) select source_id, cadence from s where state in ('active', 'repairing') and not exists (select 1 from {{runs}} r where r.source_id = s.source_id and r.created_at > timestamp '2024-01-31 00:00:00' - cast(s.cadence as interval))""")
def due_by_span(t: Tables) -> DataFrame:
    """Sources that are due by a cadence of text."""
    s = t.sources.withColumn("cadence", F.expr(CADENCE))
    return Q.due_sources(s, t.runs, AS_OF).select("source_id", "cadence")


def _entry_keys(s: DataFrame) -> DataFrame:
    keys = F.transform(F.sequence(F.lit(1), F.col("n_keys")), lambda i: F.concat(F.lit("key "), i.cast("string"), F.lit("/é")))
    return s.withColumn("entry_keys", F.when(F.col("n_keys") > 0, keys))


@query("""with k as (select s.*, case when source_id % 6 = 0 then 'skipped' when template is null or n_keys = 0 then 'misconfigured' else 'queued' end as status from {sources} s),
e as (select source_id, template, status, source_key, case when status = 'queued' then unnest(range(1, n_keys + 1)) end as i from k where status = 'queued'
  union all select source_id, template, status, source_key, null as i from k where status <> 'queued')
select source_id, case when i is null then source_key else concat('key ', i, '/é') end as key, status,
  case when i is not null then replace(template, '{{key}}', concat('key%20', i, '%2F%C3%A9')) end as url from e""")
def tick_expand(t: Tables) -> DataFrame:
    s = _entry_keys(t.sources)
    return Q.tick(s, t.sources.where("source_id % 6 <> 0"))


REQ = """select o_custkey as source_id, concat('https://x.example/o/', cast(o_orderkey as varchar), case when o_orderkey % 10 = 3 then '/new' else '' end) as url, concat('r', cast(n as varchar)) as external_key, case when n = 2 then 50 end as priority,
  case when o_orderkey % 4 = 0 then o_orderdate end as run_after, o_orderkey * 2 + n as pos from {orders} cross join (values (1), (2)) v(n) where o_orderkey % 5 = 3 and (n = 1 or o_orderkey % 7 = 0)"""
ENQUEUED = f"""with r as (select source_id, url, arg_min(external_key, pos) as new_key, coalesce(arg_max(coalesce(priority, 100), pos)) as new_priority, arg_max(coalesce(run_after, timestamp '1998-01-01 00:00:00'), pos) as new_after from ({REQ}) q group by source_id, url),
j as (select coalesce(j.source_id, r.source_id) as source_id, coalesce(j.url, r.url) as url, j.* exclude (source_id, url), r.* exclude (source_id, url), r.new_priority is not null as asked, r.new_priority is not null and coalesce(state, '') <> 'running' as reset
  from {{jobs}} j full outer join r on r.source_id = j.source_id and r.url = j.url)
select coalesce(id, (select max(id) from {{jobs}}) + row_number() over (partition by id is null order by source_id, url)) as id, source_id, url, case when id is null then new_key else external_key end as external_key, case when reset then new_priority else priority end as priority,
  case when reset then 'queued' else state end as state, case when reset then 0 else attempts end as attempts, case when reset then new_after else run_after end as run_after, case when not reset then locked_by end as locked_by, case when not reset then locked_at end as locked_at, last_error,
  case when not asked then 'kept' when id is null then 'inserted' when reset then 'reset' else 'running' end as effect from j"""


@query(ENQUEUED)
def enqueue_upsert(t: Tables) -> DataFrame:
    """Jobs after a batch of requests, some for jobs that are there and some asked for twice."""
    o = t.orders.where("o_orderkey % 5 = 3").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).where("n = 1 or o_orderkey % 7 = 0")
    r = o.select(F.col("o_custkey").alias("source_id"), F.concat(F.lit("https://x.example/o/"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 10 == 3, "/new").otherwise("")).alias("url"), F.concat(F.lit("r"), F.col("n").cast("string")).alias("external_key"), F.when(F.col("n") == 2, 50).alias("priority"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate")).alias("run_after"), (F.col("o_orderkey") * 2 + F.col("n")).alias("pos"))
    return Q.enqueue(t.jobs, r, JOBS_AS_OF)


CLAIM = """select id, source_id, priority, cast(row_number() over (order by priority, id) as int) as worker, attempts + 1 as attempts, 'running' as state, concat('worker-', row_number() over (order by priority, id)) as locked_by, timestamp '1998-01-01 00:00:00' as locked_at from {jobs}
where state = 'queued' and run_after <= timestamp '1998-01-01 00:00:00' order by priority, id limit """


@query(CLAIM + "64")
def claim_jobs(t: Tables) -> DataFrame:
    """What 64 workers claim."""
    return Q.claim(t.jobs, 64, JOBS_AS_OF)


@query(CLAIM + "500")
def drain_jobs(t: Tables) -> DataFrame:
    """What one drain takes."""
    return Q.drain(t.jobs, JOBS_AS_OF)


@query("""select source_id, min(id) as id, cast(count(*) as bigint) as waiting from {repairs} r where state = 'queued' and not exists (select 1 from {repairs} b where b.state = 'running' and b.source_id = r.source_id) group by source_id""")
def claim_compile(t: Tables) -> DataFrame:
    return Q.claim_each(t.repairs)


@query("""select id, source_id, attempts, case when attempts >= 5 then 'dead' else 'queued' end as state, cast(case when attempts >= 5 then 0 else least(pow(2, attempts) * 30, 3600) end as int) as backoff_s,
timestamp '1998-01-01 00:00:00' + cast(case when attempts >= 5 then 0 else least(pow(2, attempts) * 30, 3600) end as int) * interval '1' second as run_after, substr(repeat('e', cast(1990 + id % 20 as int)), 1, 2000) as last_error, cast(null as varchar) as locked_by, cast(null as timestamp) as locked_at from {jobs} where state = 'running'""")
def retry_backoff(t: Tables) -> DataFrame:
    return Q.fail(t.jobs.where("state = 'running'"), JOBS_AS_OF, F.repeat(F.lit("e"), (1990 + F.col("id") % 20).cast("int")))


@query("""select id, source_id, attempts, 'queued' as state, cast(null as varchar) as locked_by, cast(null as timestamp) as locked_at from {jobs} where state = 'running' and locked_at < timestamp '1998-01-01 00:00:00' - interval '900' second""")
def reclaim_stale(t: Tables) -> DataFrame:
    return Q.reclaim(t.jobs, JOBS_AS_OF)


@query("select source_id, cast(count(*) as bigint) as depth from {jobs} where state = 'queued' group by source_id")
def queue_depth(t: Tables) -> DataFrame:
    return Q.depth(t.jobs)


@query("""with a as (select source_id, max(case when status = 'active' then id end) as active, max(case when status = 'canary' then id end) as canary from {adapters} group by source_id)
select j.id, a.source_id, case when active is not null and canary is not null then case when j.id % 100 < 10 then canary else active end else coalesce(active, canary) end as adapter_id
from {jobs} j join a on a.source_id = concat('Brand#', cast(1 + j.source_id % 25 as varchar)) or a.source_id = concat('Brand', cast(1 + j.source_id % 25 as varchar))""")
def canary_routing(t: Tables) -> DataFrame:
    a = t.adapters
    pick = lambda s: F.max(F.when(F.col("status") == s, F.col("id"))).alias(s)
    by = a.groupBy("source_id").agg(pick("active"), pick("canary"))
    j = t.jobs.select(F.col("id").alias("job"), F.explode(F.array(*[F.concat(F.lit(p), (1 + F.col("source_id") % 25).cast("string")) for p in ("Brand#", "Brand")])).alias("source_id"))
    return j.join(by, "source_id").select(F.col("job").alias("id"), "source_id", Q.route(F.col("job"), F.col("active"), F.col("canary")).alias("adapter_id"))


@query("""select source_id, 'repair' as kind, 'queued' as state from {sources} s where state = 'degraded' and not exists (select 1 from {repairs} r where r.source_id = s.source_id and r.state in ('queued', 'running'))""")
def queue_repair_dedup(t: Tables) -> DataFrame:
    wanted = t.sources.where("state = 'degraded'").select("source_id", F.lit("repair").alias("kind"))
    return Q.queue_repairs(t.repairs, wanted.unionByName(wanted))


@query("""select id, host, at_ms, cast(case when host is null then at_ms else 1000 * i + max(at_ms - 1000 * i) over (partition by host order by at_ms, id rows between unbounded preceding and current row) end as bigint) as start_ms,
  cast(case when host is null then at_ms else 1000 * i + max(at_ms - 1000 * i) over (partition by host order by at_ms, id rows between unbounded preceding and current row) end - at_ms as bigint) as waited_ms
from (select *, row_number() over (partition by host order by at_ms, id) as i from (select event_id as id, case when user_id % 13 = 0 then null else concat('h', user_id % 13) end as host, cast(event_id * 37 % 1000003 as bigint) as at_ms from {events}) a) b""")
def politeness_schedule(t: Tables) -> DataFrame:
    r = t.events.select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 13 != 0, F.concat(F.lit("h"), (F.col("user_id") % 13).cast("string"))).alias("host"), (F.col("event_id") * 37 % 1000003).cast("long").alias("at_ms"))
    return Q.polite(r).select("id", "host", "at_ms", "start_ms", "waited_ms")


EVENTS_OF = "case cast(id % 9 as int) " + " ".join(f"when {i} then '{e}'" for i, (_, e, _) in enumerate(Q.FSM)) + " end"


@query(f"""select id, state, event, case event when 'claim_compile' then 'compiling' when 'claim_repair' then 'repairing' when 'compile_ok' then 'active' when 'repair_ok' then 'active' when 'compile_failed' then 'new'
 when 'repair_failed' then 'degraded' when 'degrade' then case when state = 'active' then 'degraded' else state end when 'disable' then case when state = 'active' then 'disabled' else state end when 'canary_promoted' then 'active' else state end as next_state
from (select r.id, s.state, {EVENTS_OF.replace("id %", "r.id %")} as event from {{runs}} r join {{sources}} s on s.source_id = r.source_id) x""")
def source_fsm(t: Tables) -> DataFrame:
    x = t.runs.join(t.sources, "source_id").select("id", "state", F.expr(EVENTS_OF).alias("event"))
    return x.withColumn("next_state", Q.next_state(F.col("state"), F.col("event")))


@query("select id, source_id, version from {adapters} where status = 'active'")
def active_adapter(t: Tables) -> DataFrame:
    return L.with_status(t.adapters, "active").select("id", "source_id", "version")


@query("select source_id, cast(max(version) + 1 as int) as next_version from {adapters} group by source_id")
def next_version(t: Tables) -> DataFrame:
    return L.next_version(t.adapters, t.adapters.select("source_id").distinct())


@query("""select a.id, a.source_id, a.version, case when a.status = 'canary' then 'active' when a.status = 'active' and c.id is not null then 'retired' else a.status end as status
from {adapters} a left join {adapters} c on c.source_id = a.source_id and c.status = 'canary'""")
def promote_active(t: Tables) -> DataFrame:
    return L.promote(t.adapters, t.adapters.where("status = 'canary'"))


@query("""select a.id, a.source_id, a.version, case when n.id = a.id then 'canary' when n.id is not null and a.status = 'canary' then 'rejected' else a.status end as status
from {adapters} a left join (select source_id, max(id) as id from {adapters} where status = 'draft' group by source_id) n on n.source_id = a.source_id""")
def promote_canary(t: Tables) -> DataFrame:
    return L.promote(t.adapters, t.adapters.where("status = 'draft'").groupBy("source_id").agg(F.max("id").alias("id")), "canary")


@query("""select source_id, arg_max(id, version) filter (status = 'retired') as target, case when count(*) filter (status = 'retired') > 0 then max(id) filter (status = 'active') end as rejected from {adapters} group by source_id""")
def rollback_target(t: Tables) -> DataFrame:
    return L.rollback(t.adapters)


@query("select name from (select distinct concat(lpad(cast(p_size as varchar), 3, '0'), '_', p_type) as name from {part}) f where name not in (select concat(lpad(cast(p_size as varchar), 3, '0'), '_', p_type) from {part} where p_size < 20)")
def pending_migrations(t: Tables) -> DataFrame:
    name = F.concat(F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit("_"), F.col("p_type")).alias("name")
    return L.pending(t.part.select(name).distinct(), t.part.where("p_size < 20").select(name))


@query("select l_orderkey as id, l_partkey * 2 as part_id from {lineitem} where l_partkey * 2 not in (select p_partkey from {part})")
def fk_check(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") * 2).alias("part_id"))
    return L.broken_references(rows, "part_id", t.part, "p_partkey").select("id", "part_id")


@query("select user_id as key, max(event_id) as last_use, cast(count(*) as bigint) as uses from {events} group by user_id order by max(event_id) desc limit 64")
def lru_survivors(t: Tables) -> DataFrame:
    """What a cache of 64 holds at the end."""
    return L.lru(t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("pos")), 64)


@query("""select source_id, id, cast(rn as int) as rn from (select user_id as source_id, event_id as id, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from {events}) f where rn <= 20""")
def latest_fixtures(t: Tables) -> DataFrame:
    f = t.events.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("id"), F.col("ts").alias("captured_at"))
    return L.latest(f, 20).select("source_id", "id", "rn")


CLAIMED = "select id, source_id, kind from {repairs} where state = 'queued' order by id limit 20"


@query(f"select id, source_id, kind, 'running' as state, case when kind = 'repair' then 'repairing' else 'compiling' end as source_state from ({CLAIMED}) c")
def compile_claims(t: Tables) -> DataFrame:
    """The compile runs that one round takes."""
    return C.claims(t.repairs)


SETTLED = f"""select c.id, c.source_id, c.kind, case when good then 'succeeded' else 'failed' end as state, case when good then c.id * 10 end as result_adapter_id,
  case when good then null when not known then 'the source no longer exists' when c.id % 5 = 0 then 'the run gave no outcome' else 'gate failed' end as error
from (select *, source_id in (select source_id from {{sources}} where source_id % 4 <> 1) as known, id % 5 <> 0 and id % 5 <> 1 and source_id in (select source_id from {{sources}} where source_id % 4 <> 1) as good from ({CLAIMED}) q) c"""


def _settled(t: Tables) -> tuple[DataFrame, DataFrame]:
    sources = t.sources.where("source_id % 4 <> 1")
    claimed = C.claims(t.repairs)
    outcomes = claimed.where("id % 5 <> 0").select("id", (F.col("id") % 5 != 1).alias("succeeded"), F.when(F.col("id") % 5 != 1, F.col("id") * 10).alias("adapter_id"), F.lit("gate failed").alias("message"))
    return C.settled_runs(claimed, outcomes, sources), sources


@query(SETTLED)
def compile_runs_settled(t: Tables) -> DataFrame:
    """Runs after a round: some sources are gone, a fifth of the runs crash, another fifth fails the gate."""
    return _settled(t)[0]


@query(f"""select s.source_id, s.state, case when r.state = 'succeeded' then 'active' when r.kind = 'repair' then 'degraded' else 'new' end as next_state from {{sources}} s
join (select source_id, arg_max(kind, id) as kind, arg_max(state, id) as state from ({SETTLED}) x group by source_id) r on r.source_id = s.source_id where s.source_id % 4 <> 1""")
def compile_sources_settled(t: Tables) -> DataFrame:
    """The states that sources go to after a round."""
    return C.settled_sources(*_settled(t))


@query("""with n as (select source_id, max(id) as id from {adapters} where status = 'draft' group by source_id)
select a.id, a.source_id, a.version, case when n.id % 2 = 0 and n.id = a.id then 'active' when n.id % 2 = 0 and a.status = 'active' then 'retired' else a.status end as status from {adapters} a left join n on n.source_id = a.source_id""")
def compile_adapters_settled(t: Tables) -> DataFrame:
    """Adapters after a round whose runs made the newest drafts: even ones by a first compile, odd ones by a repair."""
    made = t.adapters.where("status = 'draft'").groupBy("source_id").agg(F.max("id").alias("result_adapter_id"))
    runs = made.select("source_id", F.col("result_adapter_id").alias("id"), F.when(F.col("result_adapter_id") % 2 == 0, "compile").otherwise("repair").alias("kind"), F.lit("succeeded").alias("state"), "result_adapter_id")
    return C.settled_adapters(t.adapters, runs)
