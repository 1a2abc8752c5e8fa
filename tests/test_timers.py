"""Streams whose state acts by itself, stopped and taken up again."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from harrow.operators import health as H
from harrow.streaming import outbox as S
from harrow.streaming import timers as T

START = datetime(2024, 1, 1)
EVENT = "job string, at timestamp, kind string"
NULLS = {"p": "null_p"}


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out, schema, make):
    """One run of the stream over what is there, from its checkpoint on."""
    stream = make(S.file_stream(spark, path, spark.createDataFrame([], schema).schema, 1))
    q = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def test_leases_run_out_by_themselves(spark, tmp_path):
    """Leases of 900 s: done in time, renewed, run out while others go on, run out between two runs of the stream."""
    at = lambda s: START + timedelta(seconds=s)
    path, out = str(tmp_path / "jobs"), str(tmp_path / "out")
    make = lambda e: T.overdue(e, "job", "at", 900, ends="kind = 'done'")
    put(spark, path, [("a", at(0), "claim"), ("b", at(10), "claim"), ("c", at(20), "claim"), ("b", at(600), "done"), ("c", at(700), "claim")], EVENT)
    put(spark, path, [("x", at(1000), "claim"), ("x", at(1001), "done")], EVENT)
    first = run(spark, path, out, EVENT, make)
    assert sorted((r.key, r.at) for r in first.collect()) == [("a", at(0))]  # nobody has asked for it
    put(spark, path, [("d", at(1500), "claim")], EVENT)
    put(spark, path, [("d", at(5000), "done")], EVENT)
    second = run(spark, path, out, EVENT, make)
    assert sorted((r.key, r.at) for r in second.collect()) == [("a", at(0)), ("c", at(700)), ("d", at(1500))]
    held = spark.read.format("statestore").option("stateVarName", "last").load(f"{out}/checkpoint")
    assert held.count() == 0  # no key waits any more


def test_health_goes_on_after_a_stop(spark, tmp_path):
    """After each run the report of the prefix, over two runs of the stream and more runs than the window holds."""
    outcomes = ["ok", "schema_invalid", "blocked", "empty", "exec_error", "ok", "ok"]
    rows = [(i, i % 3, outcomes[(i * 5 + i // 7) % 7], (i * 7) % 23, (i * 7) % 23 - (i % 2 if (i * 7) % 23 else 0), None if i % 6 == 0 else (i % 10) / 16, i % 13 == 0) for i in range(120)]
    schema = "id bigint, source_id bigint, outcome string, items int, valid_items int, null_p double, canary boolean"
    path, out = str(tmp_path / "runs"), str(tmp_path / "out")
    make = lambda r: T.health_stream(r, NULLS)
    put(spark, path, rows[:50], schema)
    run(spark, path, out, schema, make)
    put(spark, path, rows[50:90], schema)
    put(spark, path, rows[90:], schema)
    got = {r.id: tuple(r) for r in run(spark, path, out, schema, make).collect()}
    runs = spark.createDataFrame(rows, schema)
    batch = {r.id: tuple(r) for r in H.health_after_each(runs, NULLS).collect()}
    dealt = {r.id: tuple(r) for r in H.health_after_each(runs, NULLS, split=5).collect()}
    assert got == batch == dealt and len(got) == sum(not r[-1] for r in rows)
    for top in (3, 60, 119):  # the last report of each source is that of the runs up to there
        want = {r.source_id: tuple(r) for r in H.health_report(runs.where(F.col("id") <= top), NULLS).collect()}
        last = {s: max(i for i, x in got.items() if x[1] == s and i <= top) for s in want}
        for s, i in last.items():
            assert [round(float(x), 5) for x in got[i][2:]] == [round(float(x), 5) for x in want[s][1:]]


def test_late_rows_are_left_out(spark, tmp_path):
    """Windows are closed by the watermark: what is later than it does not count."""
    path, out = str(tmp_path / "e"), str(tmp_path / "out")
    schema = "ts timestamp, kind string"
    day = lambda d, h=0: START + timedelta(days=d, hours=h)
    put(spark, path, [(day(0), "a"), (day(0, 5), "a"), (day(1), "b")], schema)
    put(spark, path, [(day(5), "a")], schema)
    put(spark, path, [(day(5, 1), "a")], schema)  # rows are held against the watermark of the batch before
    put(spark, path, [(day(0, 6), "a"), (day(4, 12), "b"), (day(9), "a")], schema)
    got = run(spark, path, out, schema, lambda e: S.tumbling(e, "ts", "1 day", "1 day", "kind"))
    assert sorted((r.start, r.kind, r.n) for r in got.collect()) == [(day(0), "a", 2), (day(1), "b", 1), (day(4), "b", 1), (day(5), "a", 2)]


def test_many_keys_share_a_bucket(spark, tmp_path):
    """Deadlines of many keys in two buckets over three batches, as one loop by key tells them."""
    import random
    from datetime import datetime, timedelta

    from harrow.streaming import outbox as S

    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = sorted({(rng.choice([None, *"abcdefgh"]), start + timedelta(seconds=30 * rng.randrange(400))) for _ in range(200)}, key=lambda r: (r[1], r[0] or ""))
    rows = [(k, at, i % 9 == 0) for i, (k, at) in enumerate(rows)]
    schema = "k string, at timestamp, done boolean"
    thirds = [rows[:60], rows[60:130], rows[130:]]
    for third in thirds:
        spark.createDataFrame(third, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = T.overdue(S.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), "k", "at", 600, ends="done", buckets=2)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    want, top = [], max(r[1] for r in rows)
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        for r, after in zip(own, [*[x[1] for x in own[1:]], top], strict=True):
            if not r[2] and r[1] + timedelta(seconds=600) < after:
                want.append((key, r[1]))
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_many_sources_share_a_bucket(spark, tmp_path):
    """The rings of sources dealt into two buckets, over two batches, are those of each source alone, a null one's too."""
    schema = "id long, source_id long, canary boolean, outcome string, items int, valid_items int, null_p double"
    rows = [(i, (None, 1, 2, 2**60 + 1)[i % 4], False, "ok" if i % 3 else "empty", i, i, 0.5 if i % 5 else None) for i in range(80)]
    for part in (rows[:37], rows[37:]):
        put(spark, f"{tmp_path}/in", part, schema)
        got = run(spark, f"{tmp_path}/in", f"{tmp_path}/out", schema, lambda r: T.health_stream(r, NULLS, buckets=2))
    want = H.health_after_each(spark.createDataFrame(rows, schema), NULLS).select(got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
