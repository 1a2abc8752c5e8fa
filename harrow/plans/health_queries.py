"""Queries over run metrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import health as H
from .registry import Tables, query

NULLS = {"price": "null_price", "title": "null_title"}

REPORT = """
select source_id, cast(considered as bigint) as considered, cast(blocked as bigint) as blocked,
  round(case when coalesce(ti, 0) = 0 then 0.0 else cast(ti - tv as double) / ti end, 6) as schema_invalid_rate,
  cast(coalesce(latest, 0) as bigint) as latest_items, cast(coalesce(med, 0) as double) as median_items, cast(streak as bigint) as streak,
  round(case when coalesce(wtp, 0) = 0 then 0.0 else cast(wnp as double) / wtp end, 6) as null_rate_price,
  round(case when coalesce(wtt, 0) = 0 then 0.0 else cast(wnt as double) / wtt end, 6) as null_rate_title,
  coalesce(ti > 0 and cast(ti - tv as double) / ti > 0.20, false) as trip_schema,
  coalesce(wtp > 0 and cast(wnp as double) / wtp > 0.15, false) or coalesce(wtt > 0 and cast(wnt as double) / wtt > 0.15, false) as trip_null,
  coalesce(ntrail >= 2 and med > 0 and latest < 0.6 * med, false) as trip_yield, streak >= 3 as trip_streak
from (select source_id, sum(case when ok then 1 else 0 end) as considered, sum(case when ok then 0 else 1 end) as blocked,
    sum(case when ok then items end) as ti, sum(case when ok then valid_items end) as tv, max(case when crn = 1 then items end) as latest,
    median(case when crn > 1 then items end) as med, sum(case when crn > 1 then 1 else 0 end) as ntrail,
    coalesce(min(case when outcome not in ('empty', 'exec_error') then crn end), sum(case when ok then 1 else 0 end) + 1) - 1 as streak,
    sum(case when ok and null_price is not null and items > 0 then null_price * items end) as wnp, sum(case when ok and null_price is not null and items > 0 then items end) as wtp,
    sum(case when ok and null_title is not null and items > 0 then null_title * items end) as wnt, sum(case when ok and null_title is not null and items > 0 then items end) as wtt
  from (select *, case when ok then row_number() over (partition by source_id, ok order by id desc) end as crn
    from (select *, outcome <> 'blocked' as ok from (select *, row_number() over (partition by source_id order by id desc) as rn from {runs} where not canary) a where rn <= 20) b) c
  group by source_id) d"""


@query(REPORT)
def health_report(t: Tables) -> DataFrame:
    return H.health_report(t.runs, NULLS)


AFTER = """with a as (select id, source_id, outcome, items, valid_items, null_price, null_title, row_number() over (partition by source_id order by id) as p from {runs} where not canary),
w as (select n.id as nid, n.source_id, o.*, row_number() over (partition by n.id, o.outcome <> 'blocked' order by o.p desc) as crn, o.outcome <> 'blocked' as ok from a n join (select id as oid, source_id as s, outcome, items, valid_items, null_price, null_title, p from a) o on o.s = n.source_id and o.p between n.p - 19 and n.p),
d as (select nid as id, source_id, count(*) filter (ok) as considered, count(*) filter (not ok) as blocked, sum(case when ok then items end) as ti, sum(case when ok then valid_items end) as tv, max(case when ok and crn = 1 then items end) as latest,
  median(case when ok and crn > 1 then items end) as med, count(*) filter (ok and crn > 1) as ntrail, coalesce(min(case when ok and outcome not in ('empty', 'exec_error') then crn end), count(*) filter (ok) + 1) - 1 as streak,
  sum(case when ok and null_price is not null and items > 0 then null_price * items end) as wnp, sum(case when ok and null_price is not null and items > 0 then items end) as wtp,
  sum(case when ok and null_title is not null and items > 0 then null_title * items end) as wnt, sum(case when ok and null_title is not null and items > 0 then items end) as wtt from w group by nid, source_id)
select id, """ + REPORT[REPORT.index("source_id, cast(considered") : REPORT.index("from (select source_id, sum(case when ok")] + " from d"


# The order of a sum of doubles decides the last of six digits here and there; four are compared.
@query(f"select * replace (round(null_rate_price + 1e-9, 4) as null_rate_price, round(null_rate_title + 1e-9, 4) as null_rate_title) from ({AFTER}) h")
def health_after_each(t: Tables) -> DataFrame:
    """The health of a source after each of its runs."""
    return H.health_after_each(t.runs, NULLS).withColumns({f"null_rate_{f}": F.round(F.col(f"null_rate_{f}") + 1e-9, 4) for f in NULLS})


@query("""select source_id, round(sum(null_price * items) / sum(items), 6) as null_rate from {runs} where null_price is not null and items > 0 group by source_id""")
def null_rate_weighted(t: Tables) -> DataFrame:
    r = t.runs.where("null_price is not null and items > 0")
    return r.groupBy("source_id").agg(F.round(F.sum(F.col("null_price") * F.col("items")) / F.sum("items"), 6).alias("null_rate"))


@query("""select source_id, cast(coalesce(min(case when outcome not in ('empty', 'exec_error') then rn end), count(*) + 1) - 1 as bigint) as streak
from (select *, row_number() over (partition by source_id order by id desc) as rn from {runs} where outcome <> 'blocked') w group by source_id""")
def failure_streak(t: Tables) -> DataFrame:
    """The current streak over all history: failures newer than the last run that did not fail. Only failures are
    shuffled, and what a source's newest good run is comes from one partial aggregate."""
    bad = F.col("outcome").isin(*H.FAILURES)
    r = t.runs.where("outcome <> 'blocked'").select("source_id", "id", bad.alias("bad"))
    last = r.groupBy("source_id").agg(F.max(F.when(~F.col("bad"), F.col("id"))).alias("last_good"))
    later = last.join(r.where("bad").select("source_id", "id"), "source_id", "left")
    return later.groupBy("source_id").agg(F.count(F.when(F.col("last_good").isNull() | (F.col("id") > F.col("last_good")), F.col("id"))).alias("streak"))


@query("""select id, source_id, items, cast(coalesce(mid, 0) as double) as trailing_median, coalesce(n >= 2 and mid > 0 and items < 0.6 * mid, false) as collapsed
from (select *, median(items) over w as mid, count(*) over w as n from {runs} where outcome <> 'blocked' and not canary
  window w as (partition by source_id order by id rows between 19 preceding and 1 preceding)) r""")
def rolling_yield(t: Tables) -> DataFrame:
    return H.rolling_yield(t.runs)


@query("""select source_id, cast(rn as int) as rn, id, outcome, items from (select *, row_number() over (partition by source_id order by id desc) as rn from {runs}) r where rn <= 20""")
def recent_runs(t: Tables) -> DataFrame:
    return H.recent(t.runs, 20).select("source_id", "rn", "id", "outcome", "items")


@query("""select source_id, cast(rn as int) as rn, id, outcome from (select *, row_number() over (partition by source_id order by id desc) as rn from {arm_runs} where canary) r where rn <= 100""")
def runs_for_adapter(t: Tables) -> DataFrame:
    return H.recent(t.arm_runs, 100, canary=True).select("source_id", "rn", "id", "outcome")


VERDICT = """
select source_id, cast(rc as bigint) as canary_runs, round(bc, 6) as canary_invalid_rate, round(ba, 6) as active_invalid_rate, round(mc, 6) as canary_yield, round(ma, 6) as active_yield,
  case when rc < 20 then 'wait' when bc > ba then 'reject' when ma > 0 and mc < 0.9 * ma then 'reject' else 'promote' end as verdict,
  case when rc < 20 then 'runs' when bc > ba then 'invalid_rate' when ma > 0 and mc < 0.9 * ma then 'yield' end as reason
from (select source_id, rc, case when ic = 0 then 1.0 else cast(ic - vc as double) / ic end as bc, case when ia = 0 then 1.0 else cast(ia - va as double) / ia end as ba,
    case when rc = 0 then 0.0 else cast(ic as double) / rc end as mc, case when ra = 0 then 0.0 else cast(ia as double) / ra end as ma
  from (select source_id, sum(case when canary then 1 else 0 end) as rc, sum(case when canary then 0 else 1 end) as ra, sum(case when canary then items else 0 end) as ic,
      sum(case when canary then 0 else items end) as ia, sum(case when canary then valid_items else 0 end) as vc, sum(case when canary then 0 else valid_items end) as va
    from (select *, row_number() over (partition by source_id, canary order by id desc) as rn from {arm_runs}) a where rn <= 100 and outcome <> 'blocked' group by source_id) b) c"""


@query(VERDICT)
def canary_verdict(t: Tables) -> DataFrame:
    return H.canary_verdict(t.arm_runs)


@query(
    f"""with rep as ({REPORT}), f as (select source_id, count(*) as failed from {{repairs}} where kind = 'repair' and state = 'failed' group by source_id),
o as (select distinct source_id from {{repairs}} where state in ('queued', 'running')),
j as (select rep.source_id, s.state, cast(coalesce(f.failed, 0) as bigint) as failed_repairs, o.source_id is not null as is_open,
  case when not (trip_schema or trip_null or trip_yield or trip_streak) or s.state <> 'active' then 'none' when coalesce(f.failed, 0) >= 3 then 'disabled' else 'degraded' end as action
  from rep join {{sources}} s on s.source_id = rep.source_id left join f on f.source_id = rep.source_id left join o on o.source_id = rep.source_id)
select source_id, state, action, case when action = 'none' then state else action end as next_state, action = 'degraded' and not is_open as queues_repair, failed_repairs from j"""
)
def health_action(t: Tables) -> DataFrame:
    return H.health_action(H.health_report(t.runs, NULLS), t.sources, t.repairs)


@query("""select cast(count(*) as bigint) as runs, cast(sum(items) as bigint) as items, cast(sum(valid_items) as bigint) as valid_items,
cast(sum(case when outcome in ('ok', 'schema_invalid') then 0 else 1 end) as bigint) as failed, bool_and(outcome not in ('ok', 'schema_invalid')) as all_failed
from {runs} where created_at >= timestamp '2024-01-29 00:00:00'""")
def run_summary(t: Tables) -> DataFrame:
    return H.run_summary(t.runs.where(F.col("created_at") >= F.lit(datetime(2024, 1, 29)).cast("timestamp_ntz")))


@query("""select source_id, cast(count(*) as bigint) as failed from {repairs} where kind = 'repair' and state = 'failed' group by source_id""")
def failed_repairs(t: Tables) -> DataFrame:
    return H.failed_repairs(t.repairs)
