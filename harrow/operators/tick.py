"""A tick of the pipeline, from responses to everything that follows from them.

The responses are opened once: classified, extracted, validated and keyed, and the outcome is written with all that the
sinks need, with the figures of the tick observed as it is written. Run rows, records, change events, sweeps, repair
requests and the states of sources and adapters are then read from that table. Nothing is written for a source
that is degraded or disabled, nor from a canary's run; these leave run rows only.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.jsonx import canonical
from ..store import scratch
from .gate import process
from .lifecycle import latest, promote
from .queue import ntz
from .tables import ordered_union
from .upsert import change_events, swept, upsert

#: The rate from which a field counts as failing, and how many captured pages go with a repair.
FAILING, CORPUS = 0.15, 6
STOPPED = ["degraded", "disabled"]
RULES = ["schema-invalid-rate", "required-field-null-rate", "item-yield-collapse", "consecutive-failures"]


@dataclass
class Tick:
    """runs: the run rows; items: what may be written; written: records after it; events: its changes; summary: one row."""

    runs: DataFrame
    items: DataFrame
    written: DataFrame
    events: DataFrame
    summary: DataFrame


def writable(runs_or_items: DataFrame, sources: DataFrame) -> DataFrame:
    """What may be written: rows of sources that are not stopped, and not of a canary."""
    going = sources.where(~F.col("state").isin(STOPPED)).select("source_id")
    return runs_or_items.where(~F.col("canary")).join(going, "source_id", "left_semi")


def complete_sources(runs: DataFrame) -> DataFrame:
    """Sources all of whose runs in the tick were complete: only those may lose records."""
    return runs.groupBy("source_id").agg(F.bool_and("complete").alias("whole")).where("whole").select("source_id")


def run_tick(responses: DataFrame, sources: DataFrame, records: DataFrame, schema: dict[str, Any], required: tuple[str, ...], at: datetime) -> Tick:
    """responses: id, source_id, canary, status, content_type, body, tier, fetch_ms, bytes. records: as upsert."""
    spark = responses.sparkSession
    keep = ("source_id", "canary", "tier", "fetch_ms", "bytes")
    runs, items = process(responses, schema, keep=keep, required=required)
    seen = Observation("tick")
    bad = ~F.col("outcome").isin("ok", "schema_invalid")
    path = scratch(spark, "tick")
    watched = runs.observe(seen, F.count("*").alias("jobs"), F.count(F.when(bad, 1)).alias("failed"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("valid_items"), F.lit(0)).alias("valid_items"))
    watched.write.parquet(f"{path}/runs")
    payload = items.select(*[c for c in items.columns if c != "payload"], canonical(F.col("payload")).alias("payload"))
    payload.withColumn("content_hash", F.sha2("payload", 256)).write.parquet(f"{path}/items")
    runs = spark.read.schema(watched.schema).parquet(f"{path}/runs")
    items = spark.read.parquet(f"{path}/items")
    new = writable(items, sources).select("source_id", "external_key", "payload", "content_hash", F.col("id").alias("run_id"), F.col("id").alias("job_id"), "item_idx", ntz(at).alias("seen_at"))
    events = change_events(records, new)
    after = upsert(records, new)
    gone = after.where("is_active").join(complete_sources(writable(runs, sources)), "source_id", "left_semi").join(new.select("source_id").distinct(), "source_id", "left_semi").join(new.select("source_id", "external_key").distinct(), ["source_id", "external_key"], "left_anti").select("source_id", "external_key", F.lit("gone").alias("kind"))
    written = swept(after.drop("change"), gone, ntz(at))
    changes = events.select("source_id", "external_key", "kind").unionByName(gone)
    n = changes.agg(F.count(F.when(F.col("kind") != "gone", 1)).alias("written"), F.count(F.when(F.col("kind") == "gone", 1)).alias("swept"))
    figures = [F.lit(v).cast("long").alias(k) for k, v in seen.get.items()]
    return Tick(runs, new, written, changes, n.select(*figures, "written", "swept"))


def trips(report_nulls: dict[str, str]) -> Column:
    """The rules a report has tripped, in order; once for each field with too many nulls, with its name."""
    nulls = [F.when(F.col(c) > FAILING, F.lit(f"{RULES[1]} {f}")) for f, c in report_nulls.items()]
    return F.array_compact(F.array(F.when(F.col("trip_schema"), RULES[0]), *nulls, F.when(F.col("trip_yield"), RULES[2]), F.when(F.col("trip_streak"), RULES[3])))


def repair_requests(report: DataFrame, actions: DataFrame, fixtures: DataFrame, adapters: DataFrame, fresh: DataFrame, null_cols: dict[str, str]) -> DataFrame:
    """A repair for every source that is to get one: what tripped, which fields fail, the adapter to repair and the
    pages to do it on, the fresh one (source_id, id) first and then the CORPUS newest captured, each once.

    report and actions: as health_report and health_action; null_cols: field -> the report's column."""
    newest = latest(fixtures, CORPUS).groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"].cast("string")).alias("corpus"))
    active = adapters.where("status = 'active'").select("source_id", F.col("id").alias("prior_adapter_id"))
    own = fresh.groupBy("source_id").agg(F.max("id").cast("string").alias("fresh"))
    j = report.join(actions.where("queues_repair").select("source_id"), "source_id", "left_semi").join(active, "source_id", "left").join(own, "source_id", "left").join(newest, "source_id", "left")
    failing = F.array_compact(F.array(*[F.when(F.col(c) > FAILING, F.lit(f)) for f, c in null_cols.items()]))
    ids = ordered_union(F.array_compact(F.array("fresh")), F.col("corpus"))
    return j.select("source_id", F.lit("repair").alias("kind"), trips(null_cols).alias("trips"), failing.alias("failing_fields"), "schema_invalid_rate", "median_items", "latest_items", "blocked", "prior_adapter_id", ids.alias("fixture_ids"))


def judged(adapters: DataFrame, verdicts: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(adapters, sources) after the canaries' verdicts (source_id, verdict): a promoted one takes the place of the
    active one and its source is active again, a rejected one is rejected, the rest waits."""
    canary = adapters.where("status = 'canary'").join(verdicts.select("source_id", "verdict"), "source_id")
    up = canary.where("verdict = 'promote'").select("id")
    down = canary.where("verdict = 'reject'").select("id", F.lit(True).alias("down"))
    raised = promote(adapters, up)
    after = raised.join(down, "id", "left").withColumn("status", F.when(F.col("down"), "rejected").otherwise(F.col("status"))).drop("down")
    back = canary.where("verdict = 'promote'").select("source_id", F.lit(True).alias("back"))
    states = sources.join(back, "source_id", "left").withColumn("state", F.when(F.col("back"), "active").otherwise(F.col("state"))).drop("back")
    return after, states


def degraded_sources(actions: DataFrame) -> DataFrame:
    """The sources that the tick has degraded, in order."""
    return actions.where("action = 'degraded'").select("source_id").orderBy("source_id")
