"""Captured responses on disk: a manifest with gzipped bodies; decoding of response bodies."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType


def decode_bytes(raw: bytes | None, encoding: str | None) -> str | None:
    """gzip, x-gzip, deflate and br; what cannot be decoded is taken as UTF-8 as it is."""
    if raw is None:
        return None
    try:
        kind = (encoding or "").strip().lower()
        if kind in ("gzip", "x-gzip"):
            raw = gzip.decompress(raw)
        elif kind == "deflate":
            try:
                raw = zlib.decompress(raw)
            except zlib.error:
                raw = zlib.decompress(raw, -zlib.MAX_WBITS)
        elif kind == "br":
            with pa.CompressedInputStream(pa.BufferReader(raw), "brotli") as f:
                raw = f.read()
    except (OSError, EOFError, zlib.error):
        pass
    return raw.decode("utf-8", "replace")


@F.pandas_udf(StringType())
def decode(raw: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([decode_bytes(None if r is None else bytes(r), e) for r, e in zip(raw, encoding, strict=True)], dtype=object)


def headers(m: Column) -> Column:
    """A map of header values (arrays) with lower-case names and joined values; empty ones dropped."""
    pairs = F.transform(F.filter(F.map_entries(m), lambda e: F.size(e["value"]) > 0), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.array_join(e["value"], ", ").alias("value")))
    return F.map_from_entries(pairs)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The fixtures of folder/manifest.json (an array of objects with url, status and body file names)."""
    manifest = spark.read.json(f"{folder}/manifest.json", multiLine=True)
    bodies = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    bodies = bodies.select(F.element_at(F.split("path", "/"), -1).alias("file"), decode(F.col("content"), F.lit("gzip")).alias("body"))
    status = F.coalesce(F.col("status"), F.lit(200)) if "status" in manifest.columns else F.lit(200)
    return manifest.withColumn("status", status.cast("int")).join(bodies, "file", "left")


@F.arrow_udf(BinaryType())
def compress(text: pa.Array) -> pa.Array:
    """The UTF-8 bytes of a text, gzipped; the same text gives the same bytes."""
    return pa.array([None if t is None else gzip.compress(t.encode(), mtime=0) for t in text.to_pylist()], pa.binary())


def captured(responses: DataFrame) -> DataFrame:
    """Responses as rows of the table of fixtures: the body gzipped, the status 200 where there is none."""
    rest = [c for c in responses.columns if c not in ("status", "body")]
    return responses.select(*rest, F.coalesce("status", F.lit(200)).cast("int").alias("status_code"), compress(F.col("body")).alias("body"))


def opened(fixtures: DataFrame) -> DataFrame:
    """Rows of the table of fixtures with their bodies as text again."""
    return fixtures.withColumn("body", decode(F.col("body"), F.lit("gzip")))
