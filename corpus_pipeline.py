"""A corpus pipeline of five training-data operators, applied to documents one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.decontam import decontaminate
from harrow.llm.mixing import TARGETS, domain, mix
from harrow.llm.quality_classifier import keep_good
from harrow.llm.sharding import sharded
from harrow.llm.simhash import near_dedup
from harrow.store import made, settled


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly labelled classifier rejects go."""
    return keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: linked at 3 of 64 bits or fewer under any of four seeds."""
    return near_dedup(docs, shingle=3, max_bits=3, seeds=(42, 43, 44, 45))


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), domain().alias("domain"))
    return mix(docs, labels, TARGETS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, all columns, with its bytes and its shard of 16 MiB of text at most."""
    return sharded(docs, limit=16 << 20)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("simhash_dedup", dedup_stage),
    ("decontamination", decontam_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL has no XXH64 and no trained models; tests/llm checks every stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's input. What a stage has put aside,
    its input included, is removed once its output stands; what the last one has is left to ``store.clean``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = made()
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name, since)
    return STAGES[-1][1](spark, docs, sf_dir)
