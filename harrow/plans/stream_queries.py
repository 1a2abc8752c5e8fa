"""Queries that run a stream to its end and return what it made."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.upsert import KEY, ORDER, RECORD, change_events, record_id
from ..sources import connectors as C
from ..store import scratch
from ..streaming import outbox as S
from ..streaming import timers as T
from .health_queries import AFTER, NULLS
from .registry import Tables, query
from .state_queries import MERGED, TRANS, WITH_ID


def _collect(t: Tables, stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """The stream's output as a table: Parquet for append, the final batch for complete."""
    path = scratch(t.spark, tag)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{path}/out")


def _files(t: Tables, df: DataFrame, tag: str, parts: int) -> DataFrame:
    """df as a stream of Parquet files."""
    path = scratch(t.spark, tag)
    df.repartition(parts).write.parquet(path)
    return S.file_stream(t.spark, path, df.schema, 2)


@query("select time_bucket(interval '1' day, ts) as start, event_type as kind, cast(count(*) as bigint) as n from {events} group by 1, 2")
def stream_tumbling(t: Tables) -> DataFrame:
    """Events a day and kind, counted by a stream."""
    e = t.events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    out = _collect(t, S.tumbling(_files(t, e, "feed", 4), "ts", "1 day", "40 days", "kind"), "tumbling", "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"select * exclude (change) from ({MERGED}) m")
def stream_merge(t: Tables) -> DataFrame:
    """Records after a stream of items: those of the first years in one run of the stream, the rest in another, which
    takes the state up again from its folder. A record's id is made from its key, so the state does without it."""
    folder = scratch(t.spark, "merged")
    path = scratch(t.spark, "items")
    late = F.col("seen_at") >= F.lit(datetime(1995, 1, 1)).cast("timestamp_ntz")
    S.MergedRecords(t.spark, t.record_cur.select(*[c for c in RECORD if c != "id"]), folder, 16)
    for items in (t.incoming.where(~late), t.incoming.where(late)):
        items.write.mode("append").parquet(path)
        S.MergedRecords.open(t.spark, folder).drain(S.file_stream(t.spark, path, items.schema, 10_000))
    return S.MergedRecords.open(t.spark, folder).records().withColumn("id", record_id(F.col("source_id"), F.col("external_key"))).select(*RECORD)


@query("""select source_id, external_key, content_hash, case when before is null then 'insert' else 'update' end as kind from (select *, lag(content_hash) over (partition by source_id, external_key order by seen_at, content_hash) as before from {incoming}) x where before is null or before <> content_hash""")
def stream_changes(t: Tables) -> DataFrame:
    """Change events of a stream with keyed state."""
    path = scratch(t.spark, "items")
    t.incoming.write.parquet(path)
    return _collect(t, S.keyed_changes(S.file_stream(t.spark, path, t.incoming.schema, 10_000)), "changes")


def _in_turn(t: Tables, df: DataFrame, order: str, tag: str, parts: int) -> DataFrame:
    """df as a stream of files that come one after the other, in ranges of a column."""
    path = scratch(t.spark, tag)
    # Any edges will do; exact ones would gather every value in one task.
    edges = df.agg(F.expr(f"approx_percentile({order}, array({', '.join(str(i / parts) for i in range(1, parts))}))")).first()[0] if parts > 1 else []
    bounds = [None, *edges, None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        rows = df if low is None else df.where(F.col(order) > low)
        rows = rows if high is None else rows.where(F.col(order) <= high)
        rows.coalesce(1).write.mode("append").parquet(path)
    return S.file_stream(t.spark, path, df.schema, 1)


#: A user's silence of this long counts.
SILENCE_S = 43_200


@query(f"""with e as (select user_id, ts, event_type = 'purchase' as ends, lead(ts) over (partition by user_id order by ts) as next from {{events}}), m as (select max(ts) as top from {{events}})
select cast(user_id as varchar) as key, ts as at from e cross join m where not ends and ts + interval '{SILENCE_S}' second < coalesce(next, top)""")
def stream_overdue(t: Tables) -> DataFrame:
    """Events after which their user was silent for half a day, told by timers as the stream's time goes on; a
    purchase ends the waiting."""
    e = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    out = _collect(t, T.overdue(_in_turn(t, e, "us", "silence", 4), "user_id", "ts", SILENCE_S, ends="event_type = 'purchase'"), "overdue")
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(f"select * replace (round(null_rate_price + 1e-9, 4) as null_rate_price, round(null_rate_title + 1e-9, 4) as null_rate_title) from ({AFTER}) h")
def stream_health(t: Tables) -> DataFrame:
    """The health of a source after each of its runs, from a stream of runs with the last twenty as state."""
    out = _collect(t, T.health_stream(_in_turn(t, t.runs, "id", "runs", 3), NULLS), "health")
    return out.withColumns({f"null_rate_{f}": F.round(F.col(f"null_rate_{f}") + 1e-9, 4) for f in NULLS})


@query(f"""select row_number() over (order by seen_at, job_id, item_idx, content_hash, source_id, external_key) as id, rid as record_id, source_id, external_key, kind, seen_at as created_at
from {WITH_ID.replace("{0}", f"({TRANS}) k")} x where kind <> 'unchanged'""")
def feed_source(t: Tables) -> DataFrame:
    """The change feed, appended in two batches and read through its own source by a stream that stops in between."""
    C.register(t.spark)
    path, out = scratch(t.spark, "feed"), scratch(t.spark, "consumed")
    events = change_events(t.record_cur, t.incoming).withColumns({"record_id": record_id(F.col("source_id"), F.col("external_key")), "created_at": F.col("seen_at")})
    early = F.col("seen_at") < F.lit(datetime(1995, 1, 1)).cast("timestamp_ntz")
    for rows in (events.where(early), events.where(~early)):
        C.append_feed(rows, path, [*ORDER, *KEY])
        s = t.spark.readStream.format("harrow_feed").option("path", path).option("consumer", "query").load()
        s.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(C.FEED).parquet(f"{out}/rows")
