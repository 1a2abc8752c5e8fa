"""Structured Streaming over the change feed and over captured items.

Batch and stream share the transition functions of operators.upsert. A stream keeps its state in a folder, split by
a hash of the key: a batch writes the parts it touches anew and a list of which version holds which part, so that a
batch that is run again starts from the same state, and a process that starts again goes on from the last list.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.upsert import KEY, ORDER, SMALL, applied, transitions, upsert_small
from ..store import forget, listed, made, remove, scratch


SETTLE = 16


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """New Parquet files under path, a bounded number a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], Any], checkpoint: str) -> None:
    """Hands over everything there is now, batch by batch, and stops; the checkpoint remembers what was handed
    over, as consumed_at does in the batch feed."""
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


@contextmanager
def following(stream: DataFrame, handle: Callable[[DataFrame, int], Any], checkpoint: str, every: str = "2 seconds") -> Iterator[StreamingQuery]:
    """Polls: hands over what has come in, batch by batch, as often as that, until the block is left. Stopping lets
    the checkpoint stand, so that the next follower or drain goes on from there."""
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    try:
        yield q
    finally:
        q.processAllAvailable()
        q.stop()


class MergedRecords:
    """Records kept by a stream of incoming items: each batch is one set-based upsert over the parts it touches."""

    def __init__(self, spark: SparkSession, current: DataFrame, folder: str | None = None, parts: int = 64) -> None:
        """A new state in folder, from the records there are."""
        self.spark, self.folder, self.parts, self.schema, self.last = spark, folder or scratch(spark, "records"), parts, current.schema, 0
        self._write(current.select(F.lit("r").alias("what"), "*"), 0, {}, False)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> MergedRecords:
        """The state that folder holds, as its last finished batch left it."""
        state = cls.__new__(cls)
        state.spark, state.folder = spark, folder
        state.last = max(int(n.removeprefix("n")) for n in listed(spark, f"{folder}/lists"))
        at = spark.read.parquet(f"{folder}/lists/n{state.last}").first()
        state.parts, state.schema = at["parts"], StructType.fromJson(json.loads(at["schema"]))
        return state

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.parts)).cast("int")

    def _list(self, number: int) -> dict[int, int]:
        """Which version holds each part; as many entries as there are parts."""
        rows = self.spark.read.parquet(f"{self.folder}/lists/n{number}").where("part is not null").collect()
        return {r["part"]: r["version"] for r in rows}

    def _read(self, held: dict[int, int], only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/v{v}/what=r/part={p}" for p, v in held.items() if only is None or p in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _write(self, records: DataFrame, version: int, held: dict[int, int], settle: bool = True) -> None:
        """records are the new content of the parts they lie in (what is r), and the batch's events (e); the list comes last
        and makes it count. Unless they are to settle, each task writes what it has of a part, without a shuffle."""
        part = self._part()
        placed = records.withColumn("part", part)
        (placed.repartition("what", "part") if settle else placed).write.mode("overwrite").partitionBy("what", "part").parquet(f"{self.folder}/v{version}")
        new = {int(n.removeprefix("part=")): version for n in listed(self.spark, f"{self.folder}/v{version}/what=r") if n.startswith("part=")}
        rows = [(p, v, self.parts, self.schema.json()) for p, v in {**held, **new}.items()] or [(None, None, self.parts, self.schema.json())]
        self.spark.createDataFrame(rows, "part int, version int, parts int, schema string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/lists/n{version}")

    def records(self) -> DataFrame:
        return self._read(self._list(self.last))

    def events(self) -> DataFrame:
        """What the batches have changed: KEY, ORDER, kind and the batch's number."""
        held = [f"{self.folder}/{v}/what=e" for v in listed(self.spark, self.folder) if v.startswith("v") and "what=e" in listed(self.spark, f"{self.folder}/{v}")]
        if not held:
            keys = ", ".join(f"{k} {self.schema[k].dataType.simpleString()}" for k in KEY)
            return self.spark.createDataFrame([], f"{keys}, seen_at timestamp_ntz, job_id bigint, item_idx bigint, content_hash string, kind string, batch int")
        return self.spark.read.option("recursiveFileLookup", "true").parquet(*held).select(*KEY, *ORDER, "kind", "batch")

    def apply(self, batch: DataFrame, number: int) -> None:
        """A batch of many keys is joined once, for records and events; one of few leaves the records where they are."""
        since = made()
        held = self._list(number)
        seen = batch.agg(F.collect_set(self._part()).alias("parts"), F.approx_count_distinct(F.xxhash64(*KEY)).alias("keys")).first()  # parts at most
        current = self._read(held, set(seen["parts"]))
        if seen["keys"] <= SMALL:
            known = current.join(F.broadcast(batch.select(*KEY).distinct()), KEY, "left_semi")
            changes = transitions(known, batch).where("kind <> 'unchanged'").withColumn("what", F.lit("e"))
            rows = upsert_small(current, batch).select(F.lit("r").alias("what"), *self.schema.names).unionByName(changes, allowMissingColumns=True)
        else:
            rows = applied(current, batch).select("what", *self.schema.names, *[c for c in (*ORDER, "kind") if c not in self.schema.names])
        # Every SETTLE batches the files that tasks have left side by side become one a part again.
        self._write(rows.withColumn("batch", F.lit(number)), number + 1, held, (number + 1) % SETTLE == 0)
        self.last = number + 1
        self._forget(number)
        forget(self.spark, since)

    def _forget(self, number: int) -> None:
        """Removes what neither this batch, if it is run again, nor a later one reads."""
        needed = {f"v{v}/what=r/part={p}" for n in (number, number + 1) for p, v in self._list(n).items()}
        if number > 0:
            old = {f"v{v}/what=r/part={p}" for p, v in self._list(number - 1).items()}
            for path in old - needed:
                remove(self.spark, f"{self.folder}/{path}")
            remove(self.spark, f"{self.folder}/lists/n{number - 1}")

    def drain(self, items: DataFrame) -> None:
        drain(items, self.apply, f"{self.folder}/checkpoint")


def keyed_changes(items: DataFrame, buckets: int = 4096) -> DataFrame:
    """A stream of insert and update events from a stream of items (KEY, content_hash), with the last hash of each
    key as keyed state. Keys are dealt by hash into buckets whose last hashes are one state, as a call of Python for
    every key would take far longer than the work; a batch reads and writes the buckets it touches. More keys want
    more buckets; their number is fixed by the checkpoint."""
    names = [*KEY, "content_hash"]
    held_as = pa.schema([(n, pa.string()) for n in names])

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).drop(columns="bucket").assign(new=True)
        if state.exists:
            held = pa.ipc.open_stream(state.get[0]).read_pandas()
            new = pd.concat([held.assign(seen_at=pd.Series(pd.NaT, held.index, new["seen_at"].dtype), new=False), new], ignore_index=True)
        new["code"] = new.groupby(KEY, dropna=False, sort=False).ngroup()
        new = new.sort_values(["code", "new", "seen_at", "content_hash"], ignore_index=True)
        h, first, last = new["content_hash"], new["code"] != new["code"].shift(), new["code"] != new["code"].shift(-1)
        before = h.shift().where(~first, None)
        changed = new["new"] & ~((h == before) | (h.isna() & before.isna()))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held_as, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
            w.write_table(pa.Table.from_pandas(new.loc[last, names], held_as, preserve_index=False))
        state.update((sink.getvalue().to_pybytes(),))
        yield new.loc[changed, names].assign(kind=before[changed].isna().map({True: "insert", False: "update"}).astype(object))

    kinds = dict(items.dtypes)
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int").alias("bucket")
    rows = items.select(bucket, *[F.col(k).cast("string").alias(k) for k in KEY], "seen_at", "content_hash")
    schema = ", ".join(f"{n} string" for n in [*names, "kind"])
    out = rows.groupBy("bucket").applyInPandasWithState(step, schema, "last binary", "append", GroupStateTimeout.NoTimeout)
    return out.select(*[F.col(k).cast(kinds[k]).alias(k) for k in KEY], "content_hash", "kind")


def tumbling(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts of a stream by keys and windows of time; rows later than late are left out."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
