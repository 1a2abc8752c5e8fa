"""Queries over table upkeep and stored extractors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import extractors as E
from ..operators import tables as T
from .registry import Tables, query


@query("select event_id as id, outcome, coalesce(case when event_id % 3 <> 0 then 5 end, 0) as items, substr(concat(repeat('e', 3990), event_type, '-', event_id), 1, 4000) as error, true as complete from (select r.id as event_id, r.outcome, e.event_type from {runs} r join {events} e on e.event_id = r.id) x")
def record_run(t: Tables) -> DataFrame:
    """Run rows as they are appended: defaults and cut errors."""
    r = t.runs.join(t.events.select(F.col("event_id").alias("id"), "event_type"), "id")
    r = r.select("id", "outcome", F.when(F.col("id") % 3 != 0, 5).alias("items"), F.concat(F.lit("e" * 3990), "event_type", F.lit("-"), F.col("id").cast("string")).alias("error"))
    return T.appended(r, "run").select("id", "outcome", "items", "error", "complete")


@query("select id, source_id, state, case when id % 4 = 0 then 99 else priority end as priority from {jobs}")
def keyed_update(t: Tables) -> DataFrame:
    j = t.jobs.select("id", "source_id", "state", "priority")
    return T.updated(j, t.jobs.where("id % 4 = 0").select("id", F.lit(99).alias("priority")), "id", ["priority"])


@query("select source_id, external_key, cast(count(*) as bigint) as n from {line_items} group by source_id, external_key having count(*) > 1")
def unique_check(t: Tables) -> DataFrame:
    return T.duplicates(t.line_items, "record")


@query("select event_id as id, event_id % 2 = 0 as valid, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) as uuid from (select event_id, sha256(concat(event_id, chr(0), event_type)) as h from {events}) e")
def uuid_ids(t: Tables) -> DataFrame:
    u = T.stable_uuid(F.col("event_id"), F.col("event_type"))
    shown = F.when(F.col("event_id") % 2 == 0, u).otherwise(F.concat(u, F.lit("x")))
    return t.events.select(F.col("event_id").alias("id"), T.is_uuid(shown).alias("valid"), u.alias("uuid"))


@query("select user_id as source_id, array_to_string(list_transform(list_distinct_ordered, lambda x: cast(x as varchar)), ',') as fixtures from (select user_id, (select list(x order by i) from (select x, min(i) as i from (select unnest(l) as x, unnest(range(1, len(l) + 1)) as i) group by x)) as list_distinct_ordered from (select user_id, list_concat([max(event_id)], list(event_id order by event_id desc)[1:6]) as l from {events} group by user_id) a) b")
def fixture_union(t: Tables) -> DataFrame:
    """The fresh fixture, then the six newest, each once."""
    w = Window.partitionBy("user_id").orderBy(F.col("event_id").desc())
    e = t.events.select("user_id", "event_id", F.row_number().over(w).alias("k")).where("k <= 6")
    a = e.groupBy(F.col("user_id").alias("source_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "event_id"))), lambda x: x["event_id"].cast("string")).alias("ids"), F.max("event_id").cast("string").alias("fresh"))
    return a.select("source_id", F.array_join(T.ordered_union(F.array("fresh"), F.col("ids")), ",").alias("fixtures"))


@query("select id, source_id, case when row_number() over (partition by source_id order by id) = 1 then cast(n as bigint) else 0 end as swept from (select id, source_id, source_id % 17 as n from {runs}) r")
def swept_once(t: Tables) -> DataFrame:
    """A source's sweep is counted on its first report only."""
    first = t.runs.groupBy("source_id").agg(F.min("id").alias("first")).select("first")
    j = t.runs.join(first, F.col("id") == F.col("first"), "left")
    return j.select("id", "source_id", F.when(F.col("first").isNotNull(), F.col("source_id") % 17).otherwise(0).cast("long").alias("swept"))


EXTRACTOR = '''
def extract(given):
    data = given.json()
    if given.status == 404:
        return {"not": "a list"}
    return [{"id": x["id"], "n": len(x.get("title") or "")} for x in data["items"]]
'''


@query("select id, case when variant = 4 then 'exec_error' when status = 404 then 'contract_error' when variant = 3 then 'exec_error' when n = 0 then 'empty' when n = 3 then 'exec_error' else 'ok' end as outcome, case when variant < 3 and status <> 404 and n < 3 then n else 0 end as items from {json_pages}")
def run_extractor(t: Tables) -> DataFrame:
    """The outcome of stored code on every response."""
    r = t.json_pages.withColumn("url", F.lit("u"))
    return E.run(r, EXTRACTOR).select("id", "outcome", F.size("items").alias("items"))
