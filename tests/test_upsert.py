"""Upsert, its feed and sweeps against a loop over items."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from harrow.operators import upsert as U

CUR = "source_id bigint, external_key string, content_hash string, last_seen timestamp_ntz, is_active boolean"
INC = "source_id bigint, external_key string, content_hash string, seen_at timestamp_ntz, job_id bigint, item_idx bigint"
T0 = datetime(2024, 1, 1)


def loop(current, incoming):
    state = {(s, k): [h, a] for s, k, h, _, a in current}
    events = []
    for s, k, h, *_ in sorted(incoming, key=lambda r: (r[3], r[4], r[5], r[2])):
        old = state.get((s, k))
        if old is None:
            events.append((s, k, h, "insert"))
        elif old[0] != h or not old[1]:
            events.append((s, k, h, "update"))
        state[s, k] = [h, True]
    return state, events


def test_against_loop(spark):
    rng = random.Random(3)
    cur = [(s, f"k{k}", rng.choice("abc"), T0, rng.random() < 0.7) for s in range(3) for k in range(20) if rng.random() < 0.6]
    inc = [(rng.randrange(3), f"k{rng.randrange(20)}", rng.choice("abc"), T0 + timedelta(days=rng.randrange(3)), rng.randrange(3), i) for i in range(150)]
    c, i = spark.createDataFrame(cur, CUR), spark.createDataFrame(inc, INC)
    state, events = loop(cur, inc)
    got = {(r.source_id, r.external_key): [r.content_hash, r.is_active] for r in U.upsert(c, i).collect()}
    assert got == state
    assert sorted((r.source_id, r.external_key, r.content_hash, r.kind) for r in U.change_events(c, i).collect()) == sorted(events)
    n = U.write_result(c, i).selectExpr("sum(inserted + updated) x", "sum(inserted + updated + unchanged) y").first()
    assert (n.x, n.y) == (len(events), len(inc))


FULL = "id string, source_id bigint, external_key string, payload string, content_hash string, first_seen timestamp_ntz, last_seen timestamp_ntz, last_run_id bigint, is_active boolean, gone_at timestamp_ntz"
ITEMS = "source_id bigint, external_key string, payload string, content_hash string, run_id bigint, seen_at timestamp_ntz, job_id bigint, item_idx bigint"


def test_whole_records(spark):
    """What is written of a new, an unchanged, a changed, a returned and an untouched record."""
    day = lambda n: T0 + timedelta(days=n)
    cur = [("i1", 1, "same", "{1}", "a", day(0), day(1), 7, True, None), ("i2", 1, "new text", "{1}", "a", day(0), day(1), 7, True, None), ("i3", 1, "back", "{1}", "a", day(0), day(1), 7, False, day(2)), ("i4", 1, "away", "{1}", "a", day(0), day(1), 7, True, None), ("i5", 1, "gone", "{1}", "a", day(0), day(1), 7, False, day(2))]
    inc = [(1, "same", "{ 1}", "a", 9, day(5), 1, 0), (1, "new text", "{2}", "b", 9, day(5), 1, 1), (1, "back", "{1}", "a", 9, day(5), 1, 2), (1, "fresh", "{3}", "c", 9, day(5), 1, 3), (1, "fresh", "{4}", "d", 9, day(6), 1, 4)]
    c, i = spark.createDataFrame(cur, FULL), spark.createDataFrame(inc, ITEMS)
    got = {r.external_key: tuple(r)[3:] for r in U.upsert(c, i).collect()}
    assert got == {
        "same": ("{1}", "a", day(0), day(5), 9, True, None, "unchanged"),
        "new text": ("{2}", "b", day(0), day(5), 9, True, None, "update"),
        "back": ("{1}", "a", day(0), day(5), 9, True, None, "update"),
        "away": ("{1}", "a", day(0), day(1), 7, True, None, "unchanged"),
        "gone": ("{1}", "a", day(0), day(1), 7, False, day(2), "unchanged"),
        "fresh": ("{4}", "d", day(5), day(6), 9, True, None, "insert"),
    }
    ids = {r.external_key: r.id for r in U.upsert(c, i).collect()}
    assert ids["same"] == "i1" and ids["fresh"] == spark.range(1).select(U.record_id(F.lit(1), F.lit("fresh"))).first()[0]
    feed = U.feed(U.change_events(c, i), F.col("seen_at"), U.ORDER, 40).orderBy("id").collect()
    assert [(r.id, r.external_key, r.kind, r.consumed_at) for r in feed] == [(41, "new text", "update", None), (42, "back", "update", None), (43, "fresh", "insert", None), (44, "fresh", "update", None)]
    assert feed[2].record_id == ids["fresh"]


def test_sweep_is_applied(spark):
    c = spark.createDataFrame([(1, "a", "x", T0, True), (1, "b", "x", T0, True), (1, "c", "x", T0, False)], CUR)
    gone = spark.createDataFrame([(1, "a", "gone"), (1, "c", "gone")], "source_id bigint, external_key string, kind string")
    at = T0 + timedelta(days=3)
    got = {r.external_key: (r.is_active, r.gone_at) for r in U.swept(c, gone, F.lit(at).cast("timestamp_ntz")).collect()}
    assert got == {"a": (False, at), "b": (True, None), "c": (False, None)}


def test_return_is_update(spark):
    c = spark.createDataFrame([(1, "k", "a", T0, False)], CUR)
    i = spark.createDataFrame([(1, "k", "a", T0, 1, 1)], INC)
    assert [r.kind for r in U.change_events(c, i).collect()] == ["update"]


def test_sweeps(spark):
    c = spark.createDataFrame([(1, "a", "x", T0, True), (1, "b", "x", T0 + timedelta(2), True), (1, "c", "x", T0, False), (2, "a", "x", T0, True), (3, "a", "x", T0, True)], CUR)
    seen = spark.createDataFrame([(1, "b"), (3, "z")], "source_id bigint, external_key string")
    done = spark.createDataFrame([(1,), (2,)], "source_id bigint")
    gone = lambda df: sorted((r.source_id, r.external_key) for r in df.collect())
    assert gone(U.sweep_absent(c, seen, done)) == [(1, "a")]  # 2 saw nothing, 3 is not complete
    assert gone(U.sweep_stale(c, T0 + timedelta(1), done)) == [(1, "a"), (2, "a")]


def test_sweep_needs_all_ok(spark):
    runs = spark.createDataFrame([(1, "ok", T0), (1, "ok", T0), (2, "ok", T0), (2, "timeout", T0), (3, "ok", T0)], "source_id bigint, outcome string, created_at timestamp_ntz")
    src = spark.createDataFrame([(1, "active"), (2, "active"), (3, "degraded")], "source_id bigint, state string")
    assert [r.source_id for r in U.sweep_sources(runs, src, T0).collect()] == [1]
