"""Streams against the batch operators."""

from datetime import datetime, timedelta

from harrow.operators import upsert as U
from harrow.store import scratch
from harrow.streaming import outbox as S

CUR = "source_id bigint, external_key string, content_hash string, last_seen timestamp_ntz, is_active boolean"
INC = "source_id bigint, external_key string, content_hash string, seen_at timestamp_ntz, job_id bigint, item_idx bigint"
T0 = datetime(2024, 1, 1)


def rows(day):
    return [(i % 3, f"k{i % 7}", "abc"[(i + day) % 3], T0 + timedelta(days=day, minutes=i), day, i) for i in range(20)]


def feed(spark, days):
    path = scratch(spark, "feed")
    for d in days:
        spark.createDataFrame(rows(d), INC).coalesce(1).write.mode("append").parquet(path)
    return path


def test_merge_equals_batch_and_resumes(spark):
    cur = spark.createDataFrame([(0, "k0", "z", T0, False), (9, "old", "z", T0, True)], CUR)
    path = feed(spark, [0])
    state = S.MergedRecords(spark, cur)
    schema = spark.read.parquet(path).schema
    state.drain(S.file_stream(spark, path, schema, 1))
    spark.createDataFrame(rows(1), INC).coalesce(1).write.mode("append").parquet(path)
    state.drain(S.file_stream(spark, path, schema, 1))  # only the new file
    key = lambda df: sorted((r.source_id, r.external_key, r.content_hash, r.is_active) for r in df.collect())
    whole = spark.createDataFrame(rows(0) + rows(1), INC)
    assert key(state.records()) == key(U.upsert(cur, whole))
    assert state.last == 2
    events = lambda df: sorted((r.source_id, r.external_key, r.content_hash, r.kind) for r in df.collect())
    assert events(state.events()) == events(U.change_events(cur, whole))


def test_a_new_process_goes_on(spark):
    """The state is taken up from its folder, only touched parts are written, and a batch may be run twice."""
    cur = spark.createDataFrame([(s, f"k{k}", "z", T0, True) for s in range(9) for k in range(30)], CUR)
    state = S.MergedRecords(spark, cur, parts=8)
    one = spark.createDataFrame([(1, "k1", "a", T0 + timedelta(1), 1, 1)], INC)
    state.apply(one, 0)
    held = state._list(1)
    assert sum(v == 1 for v in held.values()) == 1 and sum(v == 0 for v in held.values()) == 7
    again = S.MergedRecords.open(spark, state.folder)
    assert again.last == 1 and again.schema == state.schema
    again.apply(one, 0)
    two = spark.createDataFrame([(1, "k1", "b", T0 + timedelta(2), 2, 1), (1, "new", "c", T0 + timedelta(2), 2, 2)], INC)
    again.apply(two, 1)
    third = spark.createDataFrame([(2, "k2", "d", T0 + timedelta(3), 3, 1)], INC)
    again.apply(third, 2)
    key = lambda df: sorted((r.source_id, r.external_key, r.content_hash, r.is_active) for r in df.collect())
    assert key(S.MergedRecords.open(spark, state.folder).records()) == key(U.upsert(cur, one.unionByName(two).unionByName(third)))
    assert again.events().count() == 4


def test_following_polls_and_stops(spark):
    """What comes in while a follower runs is handed over; another one goes on where it stopped."""
    path, checkpoint, seen = feed(spark, [0]), scratch(spark, "follow"), []
    schema = spark.read.parquet(path).schema
    handle = lambda df, n: seen.append((n, df.count()))
    with S.following(S.file_stream(spark, path, schema, 8), handle, checkpoint, "100 milliseconds") as q:
        q.processAllAvailable()
        spark.createDataFrame(rows(1), INC).coalesce(1).write.mode("append").parquet(path)
    assert not q.isActive and [n for _, n in seen if n] == [20, 20]
    spark.createDataFrame(rows(2), INC).coalesce(1).write.mode("append").parquet(path)
    S.drain(S.file_stream(spark, path, schema, 8), handle, checkpoint)
    assert [n for _, n in seen if n] == [20, 20, 20]


def test_keyed_state(spark):
    path = feed(spark, [0, 1])
    out = scratch(spark, "out")
    stream = S.keyed_changes(S.file_stream(spark, path, spark.read.parquet(path).schema, 8))
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.source_id, r.external_key, r.content_hash, r.kind) for r in spark.read.parquet(out).collect())
    none = spark.createDataFrame([], CUR)
    want = sorted((r.source_id, r.external_key, r.content_hash, r.kind) for r in U.change_events(none, spark.createDataFrame(rows(0) + rows(1), INC)).collect())
    assert got == want


def test_keyed_changes_over_batches(spark, tmp_path):
    """Keys of all kinds over three batches, as one loop by key tells them; Python is called by bucket, not by key."""
    import random
    from datetime import datetime

    from harrow.streaming import outbox as S

    rng = random.Random(5)
    schema = "source_id long, external_key string, content_hash string, seen_at timestamp_ntz"
    batches = [[(rng.choice([None, 1, 2**60 + 1, 2**60 + 2]), rng.choice([None, "", "a", "b"]), rng.choice(["x", "y"]), datetime(2024, b + 1, 1 + rng.randrange(9))) for _ in range(60)] for b in range(3)]
    want, last = [], {}
    for batch in batches:
        for s, k, h, _ in sorted(batch, key=lambda r: (r[3], r[2])):
            if last.get((s, k)) != h:
                want.append((s, k, h, "update" if (s, k) in last else "insert"))
                last[s, k] = h
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = S.keyed_changes(S.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), buckets=3)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("source_id", "external_key", "content_hash", "kind").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_large_batch_is_joined_once(spark, monkeypatch):
    """Records and events of a batch of many keys come from one join, each side shuffled once, and are those of the
    two operators by themselves: keys that come again, inactive records, and a key without a source."""
    cur = spark.createDataFrame([(s, f"k{k}", "abc"[k % 3], T0, k % 4 > 0) for s in range(3) for k in range(5)] + [(9, "old", "z", T0, True)], CUR)
    batch = spark.createDataFrame([*rows(1), (None, "k1", "a", T0, 1, 1), (1, None, None, T0, 1, 2), (2, "k2", "b", None, 1, 3)], INC)
    both, order = U.applied(cur, batch), lambda d: sorted(map(repr, d.collect()))
    want = U.upsert(cur, batch)
    assert order(both.where("what = 'r'").select(want.columns)) == order(want)
    events = U.change_events(cur, batch)
    assert order(both.where("what = 'e'").select(events.columns)) == order(events)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = U.applied(cur, batch)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2
    monkeypatch.setattr(S, "SMALL", 3)
    state = S.MergedRecords(spark, cur, parts=4)
    assert state.events().count() == 0
    state.apply(batch, 0)
    state.apply(batch.limit(2), 1)
    assert order(state.records()) == order(U.upsert(want.select(cur.columns), batch.limit(2)).select(cur.columns))
    assert order(state.events().where("batch = 0").select(events.columns)) == order(events)
