"""Versions of adapters: lookup, promotion, rollback; migrations, references, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_status(adapters: DataFrame, status: str) -> DataFrame:
    """The adapter of that status; there is one a source at most."""
    return adapters.where(F.col("status") == status)


def assert_single(adapters: DataFrame) -> DataFrame:
    """Sources that break the rule of one active and one canary adapter."""
    return adapters.where("status in ('active', 'canary')").groupBy("source_id", "status").agg(F.count("*").alias("n")).where("n > 1")


def next_version(adapters: DataFrame, sources: DataFrame) -> DataFrame:
    return sources.join(adapters.groupBy("source_id").agg(F.max("version").alias("v")), "source_id", "left").select("source_id", (F.coalesce("v", F.lit(0)) + 1).cast("int").alias("next_version"))


def promote(adapters: DataFrame, chosen: DataFrame, status: str = "active") -> DataFrame:
    """adapters with chosen (ids) raised to status. An incumbent active one retires, an incumbent canary is
    rejected, in the same projection, so no source ever has two."""
    c = adapters.join(chosen.select("id"), "id", "left_semi").select("source_id", F.col("id").alias("new_id"))
    j = adapters.join(c, "source_id", "left")
    out = F.when(F.col("id") == F.col("new_id"), status).when(F.col("new_id").isNotNull() & (F.col("status") == status), "retired" if status == "active" else "rejected").otherwise(F.col("status"))
    return j.select("id", "source_id", "version", out.alias("status"))


def rollback(adapters: DataFrame) -> DataFrame:
    """Per source: the latest retired version becomes active and the active one is rejected; without a retired
    one nothing changes (target null)."""
    latest = lambda s: F.max_by("id", F.when(F.col("status") == s, F.col("version")))
    return adapters.groupBy("source_id").agg(latest("retired").alias("target"), F.max(F.when(F.col("status") == "active", F.col("id"))).alias("active")).select("source_id", "target", F.when(F.col("target").isNotNull(), F.col("active")).alias("rejected"))


def pending(files: DataFrame, applied: DataFrame) -> DataFrame:
    """Migration files not applied yet, in name order."""
    return files.join(applied, "name", "left_anti").orderBy("name")


def broken_references(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is set and names no parent."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def lru(uses: DataFrame, size: int = 64) -> DataFrame:
    """What is left in a cache of that size after uses (key, pos): the keys used last."""
    last = uses.groupBy("key").agg(F.max("pos").alias("last_use"), F.count("*").alias("uses"))
    return last.orderBy(F.col("last_use").desc()).limit(size)


def latest(fixtures: DataFrame, n: int) -> DataFrame:
    """The newest n captures of each source."""
    w = Window.partitionBy("source_id").orderBy(F.col("captured_at").desc(), F.col("id").desc())
    return fixtures.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
