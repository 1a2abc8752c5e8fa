"""A tick from responses to writes, its repairs and its verdicts."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from harrow.functions import jsonx as J
from harrow.operators import gate as G
from harrow.operators import tick as K

AT = datetime(2024, 2, 1)
SCHEMA = {"type": "object", "required": ["id"], "properties": {"id": {"type": "string"}, "price": {"type": ["number", "null"]}}}
RESPONSE = "id bigint, source_id bigint, canary boolean, status int, content_type string, body string, tier string, fetch_ms int, bytes int"
RECORD = "source_id bigint, external_key string, payload string, content_hash string, first_seen timestamp_ntz, last_seen timestamp_ntz, is_active boolean"


def page(*items):
    return json.dumps({"items": list(items)})


def tick(spark, responses, records, states):
    r = spark.createDataFrame([(*x, "http", 5, 9) for x in responses], RESPONSE)
    payloads = [(s, k, p, AT, AT, a) for s, k, p, a in records]
    c = spark.createDataFrame(payloads, "source_id bigint, external_key string, payload string, first_seen timestamp_ntz, last_seen timestamp_ntz, is_active boolean").withColumn("content_hash", F.sha2("payload", 256))
    return K.run_tick(r, spark.createDataFrame(states, "source_id bigint, state string"), c.select(*[x.split()[0] for x in RECORD.split(", ")]), SCHEMA, ("id", "price"), AT)


def test_tick(spark):
    a, b = {"id": "a", "price": 1}, {"id": "b", "price": None}
    responses = [
        (1, 1, False, 200, "application/json", page(a, b)),
        (2, 2, False, 200, "application/json", page(a)),  # degraded: no writes
        (3, 3, True, 200, "application/json", page(a)),  # canary: no writes
        (4, 4, False, 200, "application/json", page(a, {"price": 1})),  # not clean: valid items go in, nothing is swept
        (5, 5, False, 200, "application/json", page(a)),
        (6, 5, False, 503, None, ""),  # the source is not complete: nothing is swept
        (7, 6, False, 200, "application/json", page(a)),  # disabled
    ]
    old = '{"id":"a","price":1}'
    records = [(1, "a", old, True), (1, "z", "{}", True), (1, "y", "{}", False), (4, "z", "{}", True), (5, "z", "{}", True), (5, "a", old, False), (2, "z", "{}", True)]
    t = tick(spark, responses, records, [(1, "active"), (2, "degraded"), (3, "active"), (4, "repairing"), (5, "active"), (6, "disabled")])
    assert sorted(map(tuple, t.events.collect())) == [(1, "b", "insert"), (1, "z", "gone"), (4, "a", "insert"), (5, "a", "update")]
    after = {(r.source_id, r.external_key): (r.is_active, r.gone_at) for r in t.written.collect()}
    assert after[1, "z"] == (False, AT) and after[1, "y"] == (False, None) and after[5, "z"][0] and after[4, "z"][0] and after[2, "z"][0] and (2, "a") not in after and (3, "a") not in after
    assert t.summary.first().asDict() == {"jobs": 7, "failed": 1, "items": 8, "valid_items": 7, "written": 3, "swept": 1}
    runs = {r.id: r for r in t.runs.collect()}
    assert runs[1].field_nulls == {"id": 0.0, "price": 0.5} and runs[6].field_nulls is None and runs[4].outcome == "schema_invalid" and runs[1].tier == "http"


def test_tick_of_nothing(spark):
    t = tick(spark, [], [(1, "z", "{}", True)], [(1, "active")])
    assert t.events.count() == 0 and t.written.count() == 1
    assert t.summary.first().asDict() == {"jobs": 0, "failed": 0, "items": 0, "valid_items": 0, "written": 0, "swept": 0}


def test_field_nulls(spark):
    texts = [page({"a": 1, "b": None}, {"a": None, "c": 2}, [1], "x"), page(), None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    items = F.try_variant_get(J.variant(F.col("t")), "$.items", "array<variant>")
    got = [r[0] for r in d.select(G.field_nulls(F.coalesce(items, F.array().cast("array<variant>")), ("a", "z"))).collect()]
    assert got == [{"a": 0.75, "b": 1.0, "c": 0.75, "z": 1.0}, {"a": 1.0, "z": 1.0}, {"a": 1.0, "z": 1.0}]


def test_repairs(spark):
    report = "source_id bigint, schema_invalid_rate double, median_items double, latest_items bigint, blocked bigint, null_rate_p double, trip_schema boolean, trip_yield boolean, trip_streak boolean"
    r = spark.createDataFrame([(1, 0.5, 3.0, 1, 0, 0.2, True, True, False), (2, 0.0, 3.0, 3, 0, 0.15, False, False, True), (3, 0.9, 1.0, 1, 0, 0.0, True, False, False)], report)
    actions = spark.createDataFrame([(1, True), (2, True), (3, False)], "source_id bigint, queues_repair boolean")
    fixtures = spark.createDataFrame([(i, 1, datetime(2024, 1, i)) for i in range(1, 10)], "id bigint, source_id bigint, captured_at timestamp_ntz")
    adapters = spark.createDataFrame([(7, 1, "active"), (8, 1, "canary")], "id bigint, source_id bigint, status string")
    got = {x.source_id: x for x in K.repair_requests(r, actions, fixtures, adapters, spark.createDataFrame([(1, 8)], "source_id bigint, id bigint"), {"p": "null_rate_p"}).collect()}
    assert set(got) == {1, 2}
    assert got[1].trips == ["schema-invalid-rate", "required-field-null-rate p", "item-yield-collapse"] and got[1].failing_fields == ["p"] and got[1].prior_adapter_id == 7 and got[1].fixture_ids == ["8", "9", "7", "6", "5", "4"]
    assert got[2].trips == ["consecutive-failures"] and got[2].failing_fields == [] and got[2].prior_adapter_id is None and got[2].fixture_ids == []


def test_verdicts_applied(spark):
    adapters = spark.createDataFrame([(1, 1, 1, "active"), (2, 1, 2, "canary"), (3, 2, 1, "active"), (4, 2, 2, "canary"), (5, 3, 1, "active"), (6, 3, 2, "canary"), (7, 4, 1, "canary")], "id bigint, source_id bigint, version int, status string")
    verdicts = spark.createDataFrame([(1, "promote"), (2, "reject"), (3, "wait"), (4, "promote"), (5, "promote")], "source_id bigint, verdict string")
    sources = spark.createDataFrame([(1, "repairing"), (2, "repairing"), (3, "active"), (4, "degraded"), (5, "degraded")], "source_id bigint, state string")
    a, s = K.judged(adapters, verdicts, sources)
    assert {r.id: r.status for r in a.collect()} == {1: "retired", 2: "active", 3: "active", 4: "rejected", 5: "active", 6: "canary", 7: "active"}
    assert {r.source_id: r.state for r in s.collect()} == {1: "active", 2: "repairing", 3: "active", 4: "active", 5: "degraded"}
