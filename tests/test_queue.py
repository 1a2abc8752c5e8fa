"""Scheduling transitions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from harrow.operators import compile as C
from harrow.operators import health as H
from harrow.operators import lifecycle as L
from harrow.operators import queue as Q

T0 = datetime(2024, 1, 10)
JOB = "id bigint, source_id bigint, priority int, state string, attempts int, run_after timestamp_ntz, locked_at timestamp_ntz"


def jobs(spark, *rows):
    return spark.createDataFrame([(i, 1, p, s, a, T0, T0) for i, (p, s, a) in enumerate(rows)], JOB)


def test_retry(spark):
    got = [(r.state, r.backoff_s, r.run_after - T0) for r in Q.fail(jobs(spark, *[(0, "running", a) for a in (0, 1, 4, 5, 9)]), T0).orderBy("id").collect()]
    assert got == [("queued", 30, timedelta(seconds=30)), ("queued", 60, timedelta(seconds=60)), ("queued", 480, timedelta(seconds=480)), ("dead", 0, timedelta(0)), ("dead", 0, timedelta(0))]


def test_claim_order(spark):
    j = jobs(spark, (100, "queued", 0), (50, "queued", 0), (50, "queued", 2), (1, "running", 0))
    assert [(r.id, r.worker, r.attempts) for r in Q.claim(j, 2, T0).orderBy("worker").collect()] == [(1, 1, 1), (2, 2, 3)]
    assert Q.claim(j, 2, T0 - timedelta(1)).count() == 0


def test_enqueue(spark):
    """By source and address: what runs is left alone, what is there starts over, what is new gets an id."""
    later = T0 + timedelta(days=1)
    full = "id bigint, source_id bigint, url string, external_key string, priority int, state string, attempts int, run_after timestamp_ntz, locked_by string, locked_at timestamp_ntz, last_error string"
    j = spark.createDataFrame([(1, 1, "u", "k", 100, "running", 2, T0, "w", T0, None), (2, 1, "v", "k", 100, "dead", 5, T0, "w", T0, "e"), (3, 2, "u", "k", 100, "queued", 0, T0, None, None, None)], full)
    asked = [(1, "u", "x", 9, None, 1), (1, "v", "x", 9, later, 2), (1, "w", "first", 5, None, 3), (1, "w", "second", None, later, 4), (0, "z", "x", 9, None, 5)]
    r = spark.createDataFrame(asked, "source_id bigint, url string, external_key string, priority int, run_after timestamp_ntz, pos int")
    got = {(x.source_id, x.url): (x.id, x.external_key, x.priority, x.state, x.attempts, x.run_after, x.locked_by, x.last_error, x.effect) for x in Q.enqueue(j, r, T0).collect()}
    assert got == {
        (1, "u"): (1, "k", 100, "running", 2, T0, "w", None, "running"),
        (1, "v"): (2, "k", 9, "queued", 0, later, None, "e", "reset"),
        (2, "u"): (3, "k", 100, "queued", 0, T0, None, None, "kept"),
        (0, "z"): (4, "x", 9, "queued", 0, T0, None, None, "inserted"),
        (1, "w"): (5, "first", 100, "queued", 0, later, None, None, "inserted"),
    }


def test_claims_lock_and_failures_unlock(spark):
    got = Q.claim(jobs(spark, (1, "queued", 0)), 5, T0).first()
    assert (got.locked_by, got.locked_at, got.state) == ("worker-1", T0, "running")
    f = Q.fail(jobs(spark, (1, "running", 1)), T0, F.lit("x" * 3000)).first()
    assert len(f.last_error) == 2000 and f.locked_by is None and f.locked_at is None
    assert Q.drain(jobs(spark, *[(1, "queued", 0)] * 5), T0, 3).count() == 3


def test_due_page_takes_those_that_waited_longest(spark):
    src = spark.createDataFrame([(i, 1, "active", T0 - timedelta(hours=i % 4)) for i in range(8)], "source_id bigint, cadence_days int, state string, updated_at timestamp_ntz")
    none = spark.createDataFrame([], "source_id bigint, created_at timestamp_ntz")
    assert sorted(r.source_id for r in Q.due_sources(src, none, T0, 3).collect()) == [2, 3, 7]


def test_reclaim(spark):
    assert Q.reclaim(jobs(spark, (1, "running", 3)), T0 + timedelta(seconds=900)).count() == 0
    assert Q.reclaim(jobs(spark, (1, "running", 3)), T0 + timedelta(seconds=901)).first()["attempts"] == 3


def test_polite(spark):
    r = spark.createDataFrame([(1, "a", 0), (2, "a", 100), (3, "a", 5000), (4, "b", 50), (5, None, 1), (6, None, 1)], "id bigint, host string, at_ms bigint")
    assert {x.id: x.start_ms for x in Q.polite(r).collect()} == {1: 0, 2: 1000, 3: 5000, 4: 50, 5: 1, 6: 1}


def test_busy_keys_are_split(spark):
    """Ranges give what windows by key give, for a host and a source over all of them too."""
    rng = random.Random(4)
    r = spark.createDataFrame([(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(200_000)) for i in range(400)], "id bigint, host string, at_ms bigint")
    both = [sorted((x.id, x.start_ms, x.waited_ms) for x in Q.polite(r, 1000, split).collect()) for split in (10**6, 0)]
    assert both[0] == both[1]
    runs = spark.createDataFrame([(i, rng.choice([1, 1, 1, 2, 3]), rng.randrange(50), rng.choice(["ok", "ok", "empty", "blocked"]), i % 9 == 0) for i in range(400)], "id bigint, source_id bigint, items int, outcome string, canary boolean")
    both = [sorted(map(tuple, H.rolling_yield(runs, 20, split).collect())) for split in (10**6, 0)]
    assert both[0] == both[1] and len(both[0]) > 200


def test_route_and_states(spark):
    d = spark.createDataFrame([(5, "a", "c"), (10, "a", "c"), (5, None, "c"), (5, "a", None), (5, None, None)], "j bigint, a string, c string")
    assert [r[0] for r in d.select(Q.route(F.col("j"), F.col("a"), F.col("c"))).collect()] == ["c", "a", "c", "a", None]
    s = spark.createDataFrame([("active", "degrade"), ("repairing", "degrade"), ("repairing", "repair_failed"), ("new", "?")], "s string, e string")
    assert [r[0] for r in s.select(Q.next_state(F.col("s"), F.col("e"))).collect()] == ["degraded", "repairing", "degraded", "new"]


@pytest.mark.parametrize(("key", "shown"), [("a b", "a%20b"), ("é/&", "%C3%A9%2F%26"), ("!'()*~", "!'()*~"), ("a+b", "a%2Bb")])
def test_resolve(spark, key, shown):
    assert spark.range(1).select(Q.resolve_url(F.lit("x{key}y{key}"), F.lit(key))).first()[0] == f"x{shown}y{shown}"


def test_due_and_tick(spark):
    src = spark.createDataFrame([(1, 1, "active"), (2, 1, "active"), (3, 2, "repairing"), (4, 1, "degraded")], "source_id bigint, cadence_days int, state string")
    runs = spark.createDataFrame([(1, T0 - timedelta(hours=5)), (2, T0 - timedelta(days=1)), (3, T0 - timedelta(days=3))], "source_id bigint, created_at timestamp_ntz")
    assert sorted(r.source_id for r in Q.due_sources(src, runs, T0).collect()) == [2, 3]
    due = spark.createDataFrame([(1, "s1", "u/{key}", ["a", "b"]), (2, "s2", "u", None), (3, "s3", "u/{key}", None), (4, "s4", "u", None)], "source_id bigint, source_key string, template string, entry_keys array<string>")
    got = sorted((r.source_id, r.key, r.status, r.url) for r in Q.tick(due, spark.createDataFrame([(1,), (2,), (3,)], "source_id bigint")).collect())
    assert got == [(1, "a", "queued", "u/a"), (1, "b", "queued", "u/b"), (2, "s2", "queued", "u"), (3, "s3", "misconfigured", None), (4, "s4", "skipped", None)]


def test_compile_round(spark):
    """Claims, then what each kind of outcome makes of the run, its source and its adapters."""
    runs = spark.createDataFrame([(i, i, "repair" if i % 2 else "compile", "queued") for i in range(1, 7)] + [(0, 9, "compile", "running")], "id bigint, source_id bigint, kind string, state string")
    claimed = C.claims(runs, 5)
    assert sorted((r.id, r.source_state) for r in claimed.collect()) == [(1, "repairing"), (2, "compiling"), (3, "repairing"), (4, "compiling"), (5, "repairing")]
    outcomes = spark.createDataFrame([(1, True, 11, None), (2, True, 12, None), (3, False, None, "x" * 9000), (4, True, None, "no adapter")], "id bigint, succeeded boolean, adapter_id bigint, message string")
    sources = spark.createDataFrame([(i, "degraded" if i % 2 else "new") for i in (1, 2, 3, 4)], "source_id bigint, state string")
    done = C.settled_runs(claimed, outcomes, sources)
    got = {r.id: (r.state, r.result_adapter_id, r.error) for r in done.collect()}
    assert got == {1: ("succeeded", 11, None), 2: ("succeeded", 12, None), 3: ("failed", None, "x" * 8000), 4: ("failed", None, "no adapter"), 5: ("failed", None, C.MISSING)}
    assert {r.source_id: r.next_state for r in C.settled_sources(done, sources).collect()} == {1: "active", 2: "active", 3: "degraded", 4: "new"}
    assert C.settled_runs(claimed.where("id = 2"), outcomes.where("false"), sources).first()["error"] == C.CRASHED
    adapters = spark.createDataFrame([(1, 1, 1, "active"), (11, 1, 2, "canary"), (2, 2, 1, "active"), (12, 2, 2, "draft")], "id bigint, source_id bigint, version int, status string")
    assert {r.id: r.status for r in C.settled_adapters(adapters, done).collect()} == {1: "active", 11: "canary", 2: "retired", 12: "active"}


def test_versions(spark):
    a = spark.createDataFrame([(1, 1, 1, "retired"), (2, 1, 2, "retired"), (3, 1, 3, "active"), (4, 1, 4, "canary"), (5, 2, 1, "active")], "id bigint, source_id bigint, version int, status string")
    p = L.promote(a, a.where("id = 4"))
    assert {r.id: r.status for r in p.collect()} == {1: "retired", 2: "retired", 3: "retired", 4: "active", 5: "active"}
    assert L.assert_single(p).count() == 0
    assert {r.source_id: (r.target, r.rejected) for r in L.rollback(a).collect()} == {1: (2, 3), 2: (None, None)}
    assert {r.source_id: r.next_version for r in L.next_version(a, spark.createDataFrame([(1,), (9,)], "source_id bigint")).collect()} == {1: 5, 9: 1}


def test_spans_of_time(spark):
    texts = ["1 day", "1 mon 2 days", "01:30:00", "36:00:00", "-1 days +02:03:04.5", "1 year 3 mons", "2 weeks ago", "@ 1 hour 30 mins", "P1D", "", None, "soon", "1 fortnight", "1.5 hours", "3d", "1 mon -1 day"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("p", Q.interval_parts(F.col("t")))
    got = [None if r.p is None else (r.p.months, r.p.days, float(r.p.seconds)) for r in d.orderBy("i").collect()]
    assert got == [(0, 1, 0), (1, 2, 0), (0, 0, 5400), (0, 0, 129600), (0, -1, 7384.5), (15, 0, 0), (0, -14, 0), (0, 0, 5400), None, None, None, None, None, (0, 0, 5400), (0, 3, 0), (1, -1, 0)]
    at = F.lit(datetime(2024, 3, 31, 12)).cast("timestamp_ntz")
    assert [r[0] for r in d.where("i in (1, 3, 5)").orderBy("i").select(Q.before(at, F.col("p"))).collect()] == [datetime(2024, 2, 27, 12), datetime(2024, 3, 30), datetime(2022, 12, 31, 12)]
