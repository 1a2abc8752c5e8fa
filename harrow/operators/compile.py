"""One round of the compile worker as data: which runs it takes, and what their outcomes make of runs, sources and
adapters. What happens in between (an agent's calls) is the business of whoever makes the outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lifecycle import promote
from .queue import MAX_COMPILES, next_state
from .tables import ERROR_CHARS

MISSING = "the source no longer exists"
CRASHED = "the run gave no outcome"


def claims(compile_runs: DataFrame, most: int = MAX_COMPILES) -> DataFrame:
    """The oldest queued runs, most at the most, and the state their sources show meanwhile."""
    first = compile_runs.where("state = 'queued'").orderBy("id").limit(most)
    event = F.when(F.col("kind") == "repair", "claim_repair").otherwise("claim_compile")
    return first.select("id", "source_id", "kind", F.lit("running").alias("state"), next_state(F.lit("new"), event).alias("source_state"))


def settled_runs(claimed: DataFrame, outcomes: DataFrame, sources: DataFrame) -> DataFrame:
    """The claimed runs after their outcomes (id, succeeded, adapter_id, message): state, result_adapter_id and error.
    A run without a source or an outcome has failed, and one that succeeded without an adapter too."""
    known = sources.select("source_id").distinct().withColumn("known", F.lit(True))
    j = claimed.select("id", "source_id", "kind").join(outcomes, "id", "left").join(known, "source_id", "left")
    good = F.coalesce(F.col("known") & F.col("succeeded") & F.col("adapter_id").isNotNull(), F.lit(False))
    why = F.when(F.col("known").isNull(), MISSING).when(F.col("succeeded").isNull(), CRASHED).otherwise(F.col("message"))
    return j.select("id", "source_id", "kind", F.when(good, "succeeded").otherwise("failed").alias("state"), F.when(good, F.col("adapter_id")).alias("result_adapter_id"), F.when(~good, F.substring(why, 1, ERROR_CHARS["compile_run"])).alias("error"))


def settled_sources(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources of settled runs with the state they go to; the latest run of a source decides."""
    last = runs.groupBy("source_id").agg(F.max_by(F.struct("kind", "state"), "id").alias("run"))
    event = F.concat(F.col("run.kind"), F.when(F.col("run.state") == "succeeded", "_ok").otherwise("_failed"))
    return sources.join(last, "source_id").select("source_id", "state", next_state(F.col("state"), event).alias("next_state"))


def settled_adapters(adapters: DataFrame, runs: DataFrame) -> DataFrame:
    """adapters after settled runs: what a first compile made is active at once; what a repair made stays a canary
    until its runs have shown it to be as good."""
    made = runs.where("state = 'succeeded'").groupBy("source_id").agg(F.max_by(F.struct("kind", "result_adapter_id"), "id").alias("run"))
    fresh = made.where("run.kind = 'compile'").select("source_id", F.col("run.result_adapter_id").alias("id"))
    return promote(adapters, fresh)
