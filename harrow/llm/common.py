"""Shared pieces of the training-data operators: scratch tables, shared files, row identity."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..store import BATCH_BYTES, scratch, small_batches, written  # noqa: F401

#: ASCII white space, as the word patterns [^\x20\x09-\x0D]+ take it.
WHITE = " \t\n\x0b\f\r"
WHITE_RE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


class SharedFile:
    """A file of the shared folder, written piece by piece under a name of its own; commit() gives it its name, so that
    a retried or speculative task leaves one whole file."""

    def __init__(self, uri: str) -> None:
        part = uuid.uuid4().hex
        if (path := _local(uri)) is not None:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            self.file = open(f"{path}.{part}", "wb")
            self.rename = lambda: os.replace(f"{path}.{part}", path)
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(uri)
            store.create_dir(path.rpartition("/")[0], recursive=True)
            self.file = store.open_output_stream(f"{path}.{part}")
            self.rename = lambda: store.move(f"{path}.{part}", path)

    def write(self, chunk: bytes) -> None:
        self.file.write(chunk)

    def commit(self) -> None:
        self.file.close()
        self.rename()


def write_bytes(uri: str, chunks: Iterator[bytes]) -> None:
    """Writes a whole file of the shared folder."""
    f = SharedFile(uri)
    for x in chunks:
        f.write(x)
    f.commit()


def open_read(uri: str):
    """A seekable binary file of the shared folder."""
    if (path := _local(uri)) is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    t = column.type
    return column.cast(pa.large_binary() if pa.types.is_large_string(t) else pa.binary()).to_pylist()


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else. lower() does just that to pure ASCII, and far faster than translate()."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def row_hash(text: Column) -> Column:
    """With the id, stands for a row: rows alike in both get the same results by definition."""
    return F.when(text.isNotNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df bears it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def rough_bytes(df: DataFrame) -> int | None:
    """The bytes of the files a table is read from, as the optimizer has them; None where it is no single table."""
    plan = df._jdf.queryExecution().optimizedPlan()
    n = int(str(plan.stats().sizeInBytes())) if plan.collectLeaves().size() == 1 else 0
    return n if 0 < n < 1 << 60 else None


def split_count(df: DataFrame, column: str, per_part: int, least: int = 1) -> int:
    """How many parts keep the summed length of a column under per_part each; one scan of that column."""
    n = df.agg(F.sum(F.octet_length(F.col(column)).cast("long")).alias("n")).first()["n"] or 0
    return max(least, -(-n // per_part))


def least_hashed(rows: DataFrame, key: Column, k: int, total: int) -> DataFrame:
    """A sample of rows that does not depend on their number or layout: of the k least hashes of key, one row each
    (the least). A bound on the hash, widened until it passes enough, keeps all other rows out of the shuffle."""
    names, share = rows.columns, 2.0 * k / max(total, 1)
    hashed = rows.select(F.xxhash64(F.lit("sample"), key).alias("h"), F.struct(*names).alias("row"))
    while True:
        near = hashed.where(F.col("h") < -(2**63) + int(share * 2.0**64)) if share < 1 else hashed
        got = written(near.groupBy("h").agg(F.min("row").alias("row")).orderBy("h").limit(k).select("row.*"), "sample")
        if share >= 1 or got.count() >= k:
            return got
        share *= 16


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow with batches of at most BATCH_BYTES (a setting of the session, lowered where it is higher)."""
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cuts batches by rows, for operators whose working memory follows the rows at hand."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
