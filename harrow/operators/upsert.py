"""Keyed upsert with change detection, its change feed, and sweeps of absent records.

Each operator maps (state, input) to new rows; nothing is changed in place. Records have the columns of
``tables.SCHEMAS["record"]``; incoming items have the key, payload, content_hash, run_id and what ORDER names.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import written
from .tables import sequenced, stable_uuid

KEY = ["source_id", "external_key"]
#: The order in which a batch's items are applied.
ORDER = ["seen_at", "job_id", "item_idx", "content_hash"]
RECORD = ["id", *KEY, "payload", "content_hash", "first_seen", "last_seen", "last_run_id", "is_active", "gone_at"]


def record_id(*key: Column) -> Column:
    """The id of a record, made from its key: the same in every batch, without a counter to wait for."""
    return stable_uuid(*key)


def _whole(df: DataFrame, **types: str) -> DataFrame:
    """df with the columns it lacks as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def transitions(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Every incoming item with the kind of change it makes when items are applied in ORDER: insert, update or
    unchanged. The item before it under its key, or the current record, is what it is compared with."""
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    first = F.row_number().over(w) == 1
    j = incoming.join(current.select(*KEY, F.col("content_hash").alias("cur_hash"), F.col("is_active").alias("cur_active")), KEY, "left")
    j = j.withColumn("first", first).withColumn("before", F.lag("content_hash").over(w))
    same = F.when(F.col("first"), F.col("cur_hash").eqNullSafe(F.col("content_hash")) & F.coalesce("cur_active", F.lit(False))).otherwise(F.col("before") == F.col("content_hash"))
    kind = F.when(F.col("first") & F.col("cur_hash").isNull(), "insert").when(same, "unchanged").otherwise("update")
    return j.select(*KEY, *ORDER, kind.alias("kind"))


def change_events(current: DataFrame, incoming: DataFrame) -> DataFrame:
    return transitions(current, incoming).where("kind <> 'unchanged'")


def feed(changes: DataFrame, at: Column, order: list[str], after: int = 0) -> DataFrame:
    """Changes (KEY, kind) as rows of the change feed: id counts on from after in the given order."""
    rows = changes.select(record_id(F.col("source_id"), F.col("external_key")).alias("record_id"), "source_id", "external_key", "kind", at.alias("created_at"), *[c for c in order if c not in (*KEY, "kind")])
    return sequenced(rows, order, after).select("id", "record_id", "source_id", "external_key", "kind", "created_at", F.lit(None).cast("timestamp_ntz").alias("consumed_at"))


def write_result(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Inserted, updated and unchanged items of each source."""
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    return transitions(current, incoming).groupBy("source_id").agg(n("insert").alias("inserted"), n("update").alias("updated"), n("unchanged").alias("unchanged"))


def upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The records after the batch, and the change each has seen: the last item of a key wins; what came is active
    again and no longer gone. An unchanged record is seen, and keeps its payload. Columns that either side lacks
    are null."""
    current, last = _sides(current, incoming)
    return _merged(current.join(last, KEY, "full_outer"))


#: Keys of a batch that are sent to every task of the records' scan, rather than the records to the keys.
SMALL = 1 << 16


def upsert_small(current: DataFrame, incoming: DataFrame, most: int = SMALL) -> DataFrame:
    """As upsert, without a shuffle of the records where the batch has few keys (counted): they go to the tasks that
    scan the records, and those that no record has are found by a second scan of the keys alone. KEY is unique in
    current."""
    current, last = _sides(current, incoming)
    last = written(last, "batch")
    if last.count() > most:
        return _merged(current.join(last, KEY, "full_outer"))
    known = current.select(*KEY).join(F.broadcast(last.select(*KEY)), KEY, "left_semi")
    fresh = last.join(F.broadcast(known), KEY, "left_anti")  # as many rows as the batch has, at most
    nothing = fresh.select(*[F.col(c) if c in KEY else F.lit(None).cast(t).alias(c) for c, t in current.dtypes], "new", "new_seen", "new_first")
    return _merged(current.join(F.broadcast(last), KEY, "left").unionByName(nothing))


def applied(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The records after the batch (upsert) and the items' transitions, from one join in which either side is shuffled
    once: what is r for a record and e for an item that changed something; columns of the other kind are null."""
    current, incoming = _typed(current, incoming)
    w, key = Window.partitionBy(*KEY).orderBy(*ORDER), Window.partitionBy(*KEY)
    items = incoming.select(*KEY, *[c for c in ORDER if c != "content_hash"], F.struct("payload", "content_hash", "run_id").alias("new"), F.max("seen_at").over(key).alias("new_seen"), F.min("seen_at").over(key).alias("new_first"),
        (F.row_number().over(w) == 1).alias("first"), F.lead(F.lit(True)).over(w).isNull().alias("last"), F.lag("content_hash").over(w).alias("before"))
    j = current.join(items, KEY, "full_outer")
    cur, new = F.col("content_hash"), F.col("new.content_hash")
    same = F.when(F.col("first"), cur.eqNullSafe(new) & F.coalesce("is_active", F.lit(False))).otherwise(F.col("before") == new)
    kind = F.when(F.col("first") & cur.isNull(), "insert").when(same, "unchanged").otherwise("update")
    event = F.struct(*KEY, *[(new if c == "content_hash" else F.col(c)).alias(c) for c in ORDER], kind.alias("kind"))
    shown = _record().items()
    record = F.struct(*[c.alias(n) for n, c in shown])
    both = j.select(F.when(F.coalesce("last", F.lit(True)), record).alias("r"), F.when(F.col("new").isNotNull() & (kind != "unchanged"), event).alias("e"))
    rows = both.select(F.explode(F.filter(F.array(F.struct(F.lit("r").alias("what"), "r", F.lit(None).cast(both.schema["e"].dataType).alias("e")), F.struct(F.lit("e").alias("what"), F.lit(None).cast(both.schema["r"].dataType).alias("r"), "e")), lambda x: x["r"].isNotNull() | x["e"].isNotNull())).alias("x"))
    names = [n for n, _ in shown]
    shared = [n for n in names if n in (*KEY, "content_hash")]
    return rows.select("x.what", *[F.coalesce(f"x.r.{n}", f"x.e.{n}").alias(n) if n in shared else F.col(f"x.r.{n}") for n in names], *[F.col(f"x.e.{n}") for n in (*ORDER, "kind") if n not in shared])


def _sides(current: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records, with all columns, and what the batch last says of each key."""
    current, incoming = _typed(current, incoming)
    last = incoming.groupBy(*KEY).agg(
        F.max_by(F.struct("payload", "content_hash", "run_id"), F.struct(*ORDER)).alias("new"), F.max("seen_at").alias("new_seen"), F.min("seen_at").alias("new_first")
    )
    return current, last


def _typed(current: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    kind = dict(incoming.dtypes).get("payload") or dict(current.dtypes).get("payload", "string")
    current = _whole(current, id="string", payload=kind, first_seen="timestamp_ntz", last_run_id="bigint", gone_at="timestamp_ntz")
    return current, _whole(incoming, payload=kind, run_id="bigint")


def _merged(j: DataFrame) -> DataFrame:
    return j.select(*[c.alias(n) for n, c in _record().items()])


def _record() -> dict[str, Column]:
    """What becomes of a record (null where there is none) and what the batch last says of it (new, or null)."""
    came, there = F.col("new").isNotNull(), F.col("content_hash").isNotNull()
    changed = came & (~F.col("content_hash").eqNullSafe(F.col("new.content_hash")) | ~F.col("is_active"))
    return {
        "id": F.coalesce("id", record_id(F.col("source_id"), F.col("external_key"))),
        **{k: F.col(k) for k in KEY},
        "payload": F.when(changed | ~there, F.col("new.payload")).otherwise(F.col("payload")),
        "content_hash": F.coalesce("new.content_hash", "content_hash"),
        "first_seen": F.coalesce("first_seen", "new_first"),
        "last_seen": F.when(came, F.greatest("new_seen", "last_seen")).otherwise(F.col("last_seen")),
        "last_run_id": F.when(came, F.col("new.run_id")).otherwise(F.col("last_run_id")),
        "is_active": came | F.coalesce("is_active", F.lit(False)),
        "gone_at": F.when(~came, F.col("gone_at")),
        "change": F.when(~there, "insert").when(changed, "update").otherwise("unchanged"),
    }


def swept(current: DataFrame, gone: DataFrame, at: Column) -> DataFrame:
    """current after a sweep: the records with the keys of gone are inactive, and gone since at."""
    g = gone.select(*KEY).distinct().withColumn("swept", F.lit(True))
    hit = F.coalesce("swept", F.lit(False)) & F.col("is_active")
    current = _whole(current, gone_at="timestamp_ntz")
    new = {"is_active": F.col("is_active") & ~hit, "gone_at": F.when(hit, at).otherwise(F.col("gone_at"))}
    return current.join(g, KEY, "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in current.columns])


def sweep_absent(current: DataFrame, seen: DataFrame, complete: DataFrame) -> DataFrame:
    """Active records that a complete tick of their source did not see. complete: the source_ids it holds for;
    a source that saw nothing is left alone."""
    ready = complete.join(seen.select("source_id").distinct(), "source_id", "left_semi")
    return current.where("is_active").join(ready, "source_id", "left_semi").join(seen.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, F.lit("gone").alias("kind"))


def sweep_stale(current: DataFrame, since: datetime, complete: DataFrame) -> DataFrame:
    """Active records of complete sources last seen before since."""
    stale = F.col("is_active") & (F.col("last_seen") < F.lit(since).cast("timestamp_ntz"))
    return current.where(stale).join(complete, "source_id", "left_semi").select(*KEY, "last_seen", F.lit("gone").alias("kind"))


def sweep_sources(runs: DataFrame, sources: DataFrame, since: datetime) -> DataFrame:
    """Active sources all of whose runs of the tick were ok."""
    tick = runs.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    return tick.groupBy("source_id").agg(F.bool_and(F.col("outcome") == "ok").alias("ok"), F.count("*").alias("jobs")).where("ok").join(sources.where("state = 'active'"), "source_id", "left_semi").select("source_id", "jobs")


def outbox_read(events: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest events not consumed yet."""
    return events.where(F.col("consumed_at").isNull()).orderBy("id").limit(limit)


def mark_consumed(events: DataFrame, ids: DataFrame, at: datetime) -> DataFrame:
    """events with consumed_at set for ids (column id)."""
    done = ids.select("id").distinct().withColumn("done", F.lit(True))
    return events.join(done, "id", "left").withColumn("consumed_at", F.when(F.col("done"), F.coalesce("consumed_at", F.lit(at))).otherwise(F.col("consumed_at"))).drop("done")
