"""The domain's tables: schemas, vocabularies, appends, keyed updates and the invariants between rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..store import written

SCHEMAS = {
    "source": "id string, key string, intent string, entry_url string, url_pattern string, output_schema variant, required_fields array<string>, cadence interval day to second, state string, fetch_hints variant, created_at timestamp_ntz, updated_at timestamp_ntz",
    "adapter": "id string, source_id string, version int, status string, fetch_plan variant, code string, code_hash string, notes string, compile_run_id string, created_at timestamp_ntz",
    "fixture": "id string, source_id string, url string, tier string, status_code int, headers map<string,string>, body binary, expected variant, captured_at timestamp_ntz",
    "compile_run": "id string, source_id string, kind string, state string, trigger variant, input variant, tokens_in int, tokens_out int, cost_usd decimal(10,4), iterations int, error string, attempts int, run_after timestamp_ntz, created_at timestamp_ntz",
    "compile_step": "id bigint, compile_run_id string, n int, tool string, input variant, output_summary variant",
    "job": "id bigint, source_id string, url string, external_key string, priority int, state string, attempts int, run_after timestamp_ntz, locked_by string, locked_at timestamp_ntz, last_error string",
    "run": "id bigint, job_id bigint, source_id string, adapter_id string, adapter_version int, canary boolean, http_status int, fetch_ms int, parse_ms int, bytes int, items int, valid_items int, field_nulls map<string,double>, outcome string, error string, tier_used string, escalated boolean, complete boolean, created_at timestamp_ntz",
    "record": "id string, source_id string, external_key string, payload variant, content_hash string, first_seen timestamp_ntz, last_seen timestamp_ntz, last_run_id bigint, is_active boolean, gone_at timestamp_ntz",
    "change_event": "id bigint, record_id string, source_id string, kind string, created_at timestamp_ntz, consumed_at timestamp_ntz",
}
#: The vocabularies of state columns.
VALUES = {
    "source.state": ["new", "compiling", "active", "degraded", "repairing", "disabled"],
    "adapter.status": ["draft", "canary", "active", "retired", "rejected"],
    "compile_run.kind": ["compile", "repair"],
    "compile_run.state": ["queued", "running", "succeeded", "failed", "abandoned"],
    "job.state": ["queued", "running", "done", "failed", "dead"],
    "run.outcome": ["ok", "schema_invalid", "empty", "fetch_error", "exec_error", "timeout", "blocked"],
    "change_event.kind": ["insert", "update", "gone"],
}
UNIQUE = {"source": ["key"], "adapter": ["source_id", "version"], "job": ["source_id", "url"], "record": ["source_id", "external_key"]}
ERROR_CHARS = {"run": 4000, "compile_run": 8000, "job": 2000}
#: Defaults that an append fills in.
DEFAULTS = {"run": {"items": 0, "valid_items": 0, "escalated": False, "complete": True}, "source": {"state": "active"}, "job": {"priority": 100, "state": "queued", "attempts": 0}, "compile_run": {"state": "queued", "tokens_in": 0, "tokens_out": 0, "attempts": 0}}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def appended(rows: DataFrame, table: str) -> DataFrame:
    """rows as they are appended: all columns of the table they have, defaults filled in, errors cut."""
    names = [c.split()[0] for c in SCHEMAS[table].split(", ")]
    cols = []
    for c in [n for n in names if n in rows.columns or n in DEFAULTS.get(table, {})]:
        v = F.col(c) if c in rows.columns else F.lit(None)
        if c in DEFAULTS.get(table, {}):
            v = F.coalesce(v, F.lit(DEFAULTS[table][c]))
        if c in ("error", "last_error"):
            v = F.substring(v, 1, ERROR_CHARS[table])
        cols.append(v.alias(c))
    return rows.select(*cols)


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: list[str], at: datetime | None = None) -> DataFrame:
    """rows with columns taken from changes where the key is in them; updated_at set, if asked for and there."""
    new = changes.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    j = rows.join(new, key, "left")
    hit = F.coalesce("__hit", F.lit(False))
    out = [F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.when(hit, F.lit(at).cast("timestamp_ntz")).otherwise(F.col(c)).alias(c) if c == "updated_at" and at is not None else F.col(c) for c in rows.columns]
    return j.select(*out)


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in ranges of the given order, each sorted, with __part (the range) and __place (the place in the order).
    Written, so that every reader sees the same ranges."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    return written(dealt, "ranged").withColumn("__part", F.shiftright("__place", 33))


#: Rows of one key that a window takes in one task; keys with more are dealt by ranges.
SPLIT = 1_000_000


def busiest(rows: DataFrame, key: str) -> int:
    """The rows of the key that has most."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0


def sequenced(rows: DataFrame, order: list[str], after: int = 0) -> DataFrame:
    """rows with id, counting on from after in the given order: ranges of the order are counted by themselves, and
    each starts where those before it end."""
    dealt = ranged(rows, order).withColumn("__nth", F.col("__place").bitwiseAND(F.lit((1 << 33) - 1).cast("long")) + 1)
    # One row a range, whose number is that of the shuffle's partitions.
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    out = dealt.join(F.broadcast(before), "__part").withColumn("id", F.col("__before") + F.col("__nth") + after)
    return out.drop("__place", "__part", "__nth", "__before")


def duplicates(rows: DataFrame, table: str) -> DataFrame:
    """Keys that break the table's uniqueness."""
    return rows.groupBy(*UNIQUE[table]).agg(F.count("*").alias("n")).where("n > 1")


def unknown_values(rows: DataFrame, table: str) -> DataFrame:
    """Rows whose state column is outside its vocabulary."""
    bad = F.lit(False)
    for name, allowed in VALUES.items():
        t, c = name.split(".")
        if t == table and c in rows.columns:
            bad |= ~F.col(c).isin(allowed)
    return rows.where(bad)


def is_uuid(c: Column) -> Column:
    return c.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def stable_uuid(*parts: Column) -> Column:
    """A UUID-shaped id made from its parts, the same on every run."""
    h = F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def ordered_union(first: Column, then: Column) -> Column:
    """Ids of both arrays without repeats, in order."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(first, none), F.coalesce(then, none)))


def removed_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows left when only these sources remain: the cascade of a deleted source."""
    return rows.join(sources.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
