"""Keyed state that acts by itself: deadlines in event time, and the last runs of each source.

Both keep their state in Spark's state store, by key, with the checkpoint of the query; a query that starts again
goes on from there.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..operators.health import WINDOW, report_of

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LAST = StructType([StructField("held", BinaryType())])
HELD = pa.schema([("key", pa.string()), ("us", pa.int64())])


class _Deadlines(StatefulProcessor):
    """The last events of a bucket of keys, and one timer, at the first of their deadlines. Python is called by bucket, as
    a call for every key would take far longer than the work. Times are microseconds."""

    def __init__(self, span_ms: int) -> None:
        self.span = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LAST)

    def _held(self) -> pd.DataFrame:
        return pa.ipc.open_stream(self.last.get()[0]).read_pandas() if self.last.exists() else pa.Table.from_pylist([], HELD).to_pandas()

    def _hold(self, held: pd.DataFrame) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if held.empty:
            self.last.clear()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, HELD) as w:
            w.write_table(pa.Table.from_pandas(held, HELD, preserve_index=False))
        self.last.update((sink.getvalue().to_pybytes(),))
        self.handle.registerTimer(int(held["us"].min()) // 1000 + self.span)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[["key", "us", "ends"]].assign(new=True)
        e = pd.concat([self._held().assign(ends=False, new=False), new], ignore_index=True)
        e["us"], e["ends"], e["new"] = e["us"].astype("int64"), e["ends"].astype(bool), e["new"].astype(bool)
        e["code"] = e.groupby("key", dropna=False, sort=False).ngroup()
        known = e["code"].map(e[~e["new"]].set_index("code")["us"])
        e = e[~(e["us"] < known)]  # older than what is known: it changes no deadline
        e = e.sort_values(["code", "us", "new", "ends"], ignore_index=True)
        more = e["code"] == e["code"].shift(-1)
        passed = more & ~e["ends"] & (e["us"].shift(-1, fill_value=0) > e["us"] + self.span * 1000)
        self._hold(e.loc[~more & ~e["ends"], ["key", "us"]])
        if passed.any():
            yield e.loc[passed, ["key", "us"]]

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self._held()
        due = held["us"] // 1000 + self.span
        passed = (due < timerValues.getCurrentWatermarkInMs()) | (due <= expiredTimerInfo.getExpiryTimeInMs())
        self._hold(held[~passed])
        if passed.any():
            yield held[passed]

    def close(self) -> None:
        pass


def overdue(events: DataFrame, key: str, at: str, span_s: int, late: str = "0 seconds", ends: str = "false", buckets: int = 512) -> DataFrame:
    """A stream with a row (key as text, at) for every event after which its key had none for span_s seconds: leases
    that ran out, sources whose cadence has passed, records not seen any more. It comes when the watermark passes the
    deadline, without another event of the key. ends: a condition for events that end the key, as a finished job
    does its lease. Events may be so late; later ones are left out, and those without a time. Keys are dealt by hash into
    buckets, whose number is fixed by the checkpoint; more keys want more of them."""
    events.sparkSession.conf.set(STORE, ROCKS)
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.coalesce(F.expr(ends), F.lit(False)).alias("ends")).withWatermark("at", late)
    rows = rows.where("at is not null").withColumns({"us": F.unix_micros("at"), "bucket": F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")})
    out = StructType([StructField("key", StringType()), StructField("us", LongType())])
    found = rows.groupBy("bucket").transformWithStateInPandas(_Deadlines(span_s * 1000), out, "Append", "EventTime")
    return found.select("key", F.timestamp_micros("us").alias("at"))


class _Ring(StatefulProcessor):
    """The last runs of each key of a bucket, newest first, pickled as one state."""

    def __init__(self, size: int, names: list[str]) -> None:
        self.size, self.names = size, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rings = handle.getValueState("rings", LAST)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = pickle.loads(self.rings.get()[0]) if self.rings.exists() else {}
        new = pd.concat(list(rows)).sort_values("id")
        out = []
        plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
        for run, source, *values in zip(*(new[n] for n in ("id", "source_id", *self.names)), strict=True):
            held[source] = [dict(zip(self.names, map(plain, values), strict=True)), *held.get(source, [])][: self.size]
            out.append((run, source, held[source]))
        self.rings.update((pickle.dumps(held),))
        yield pd.DataFrame(out, columns=["id", "source_id", "ring"])

    def close(self) -> None:
        pass


def health_stream(runs: DataFrame, null_cols: dict[str, str], size: int = WINDOW, buckets: int = 512) -> DataFrame:
    """A stream with the health of a run's source once that run is there, as health_after_each has it, from a stream of
    runs in the order of their ids. The rings of the last runs are the state, by bucket of sources, whose number is fixed by
    the checkpoint; the rules are the batch's."""
    runs.sparkSession.conf.set(STORE, ROCKS)
    names = ["outcome", "items", "valid_items", *null_cols.values()]
    rows = runs.where("not canary").select("id", "source_id", *names)
    source = rows.schema["source_id"].dataType
    item = StructType([StructField(n, rows.schema[n].dataType) for n in names])
    out = f"id {rows.schema['id'].dataType.simpleString()}, source_id string, ring array<{item.simpleString()}>"
    dealt = rows.withColumns({"bucket": F.pmod(F.xxhash64("source_id"), F.lit(buckets)).cast("int"), "source_id": F.col("source_id").cast("string")})
    rings = dealt.groupBy("bucket").transformWithStateInPandas(_Ring(size, names), out, "Append", "None")
    return rings.select("id", F.col("source_id").cast(source).alias("source_id"), *report_of(F.col("ring"), null_cols))
