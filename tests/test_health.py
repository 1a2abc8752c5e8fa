"""Health rules: boundary values, and the windowed report against a plain Python version."""

import random
import statistics

import pytest

from harrow.operators import health as H

SCHEMA = "id bigint, source_id bigint, canary boolean, outcome string, items int, valid_items int, null_title double"


def report(spark, newest_first):
    """newest_first: (outcome, items, valid, null rate or None)."""
    rows = [(1000 - i, 1, False, o, n, v, r) for i, (o, n, v, r) in enumerate(newest_first)]
    return H.health_report(spark.createDataFrame(rows, SCHEMA), {"title": "null_title"}).first()


@pytest.mark.parametrize(
    ("runs", "trips"),
    [
        ([("ok", 40, 30, None)], {"trip_schema"}),
        ([("ok", 50, 40, None)], set()),  # exactly 0.20
        ([("ok", 1, 1, 1.0), ("ok", 100, 100, 0.0)], set()),
        ([("ok", 10, 10, 0.2)], {"trip_null"}),
        ([("ok", n, n, None) for n in (0, 0, 10, 10, 10)], {"trip_yield"}),
        ([("ok", n, n, None) for n in (0, 10)], set()),
        ([("ok", n, n, None) for n in (6, 10, 10)], set()),  # exactly 0.6 of the median
        ([("empty", 0, 0, None)] * 3 + [("ok", 5, 5, None)], {"trip_streak", "trip_yield"} - {"trip_yield"}),
        ([("blocked", 0, 0, None)] * 5 + [("exec_error", 0, 0, None)] * 3, {"trip_streak"}),
        ([("blocked", 0, 0, None)] * 20 + [("exec_error", 0, 0, None)] * 3, set()),  # blocked runs fill the window
    ],
)
def test_trips(spark, runs, trips):
    r = report(spark, runs)
    assert {k for k in ("trip_schema", "trip_null", "trip_yield", "trip_streak") if r[k]} == trips


def plain(runs):
    win = runs[:20]
    c = [r for r in win if r[0] != "blocked"]
    ti, tv = sum(r[1] for r in c), sum(r[2] for r in c)
    trail = [r[1] for r in c[1:]]
    med = statistics.median(trail) if trail else 0
    w = [(r[3] * r[1], r[1]) for r in c if r[3] is not None and r[1] > 0]
    streak = next((i for i, r in enumerate(c) if r[0] not in H.FAILURES), len(c))
    nulls = sum(x for x, _ in w) / sum(n for _, n in w) if w else 0
    return len(c), len(win) - len(c), round((ti - tv) / ti if ti else 0, 6), med, streak, round(nulls, 6), len(trail) >= 2 and med > 0 and c[0][1] < 0.6 * med


def test_report_against_python(spark):
    rng = random.Random(5)
    sources, rows = {}, []
    for s in range(60):
        runs = []
        for _ in range(rng.randint(1, 30)):
            o = rng.choice(["ok", "ok", "schema_invalid", "blocked", "empty", "exec_error", "timeout"])
            n = rng.randint(1, 30) if o in ("ok", "schema_invalid") else 0
            runs.append((o, n, rng.randint(0, n), rng.choice([None, 0.0, 0.25, 0.5]) if n else None))
        sources[s] = runs
        rows += [(1000 - i, s, False, *r) for i, r in enumerate(runs)]
    rng.shuffle(rows)
    for r in H.health_report(spark.createDataFrame(rows, SCHEMA), {"title": "null_title"}).collect():
        got = (r.considered, r.blocked, r.schema_invalid_rate, r.median_items, r.streak, r.null_rate_title, r.trip_yield)
        assert got == pytest.approx(plain(sources[r.source_id]), abs=1e-6)


@pytest.mark.parametrize(
    ("canary", "active", "verdict"),
    [([(10, 10)] * 19, [(10, 10)] * 20, "wait"), ([(10, 10)] * 20, [(10, 10)] * 20, "promote"), ([(8, 8)] * 20, [(10, 10)] * 20, "reject"), ([(10, 9)] * 20, [(10, 10)] * 20, "reject"), ([(19, 19)] * 20, [(20, 20)] * 20, "promote"), ([(0, 0)] * 20, [(10, 9)] * 20, "reject")],
)
def test_canary(spark, canary, active, verdict):
    rows = [(i, 1, True, "ok", *x, None) for i, x in enumerate(canary)] + [(100 + i, 1, False, "ok", *x, None) for i, x in enumerate(active)]
    assert H.canary_verdict(spark.createDataFrame(rows, SCHEMA)).first()["verdict"] == verdict


def test_action(spark):
    rep = spark.createDataFrame([(s, s != 4, False, False, False) for s in range(1, 6)], "source_id bigint, trip_schema boolean, trip_null boolean, trip_yield boolean, trip_streak boolean")
    src = spark.createDataFrame([(1, "active"), (2, "active"), (3, "degraded"), (4, "active"), (5, "active")], "source_id bigint, state string")
    comp = spark.createDataFrame([(2, "repair", "failed")] * 3 + [(5, "repair", "queued")], "source_id bigint, kind string, state string")
    got = {r.source_id: (r.action, r.queues_repair) for r in H.health_action(rep, src, comp).collect()}
    assert got == {1: ("degraded", True), 2: ("disabled", False), 3: ("none", False), 4: ("none", False), 5: ("degraded", False)}


def test_empty(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert H.health_report(e, {"title": "null_title"}).count() == 0
    assert H.canary_verdict(e).count() == 0
    assert H.run_summary(e).first()["runs"] == 0
