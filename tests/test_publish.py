"""Tables that are published together, and upserts that leave the records where they are."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from harrow.functions import jsonx as J
from harrow.operators import upsert as U
from harrow.operators.publish import Conflict, Publication, register
from harrow.store import listed

CODE = "def extract(given):\n    return given.json()['items']\n"
SCHEMA = {"type": "object", "required": ["id"], "properties": {"id": {"type": "string"}}}


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n int")


def numbers(df):
    return None if df is None else sorted(r[0] for r in df.collect())


def test_all_or_nothing(spark, tmp_path):
    p = Publication(spark, f"file://{tmp_path}/pub")
    assert p.number() == 0 and p.read("a") is None
    assert p.publish(lambda now: {"a": rows(spark, 1), "b": rows(spark, 2)}, ["a", "b"]) == 1
    boom = F.udf(lambda n: 1 // 0, "int")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        p.publish(lambda now: {"a": rows(spark, 9), "b": rows(spark, 9).select(boom("n").alias("n"))}, ["a", "b"])
    assert (p.number(), numbers(p.read("a")), numbers(p.read("b"))) == (1, [1], [2])
    assert p.publish(lambda now: {"a": now["a"].unionByName(rows(spark, 3)), "b": rows(spark, 4)}, ["a", "b"], append=("b",)) == 2
    again = Publication(spark, p.folder)  # as a new process sees it
    assert (numbers(again.read("a")), numbers(again.read("b")), numbers(again.read("a", 1))) == ([1, 3], [2, 4], [1])
    p.tidy(keep=1)
    assert (numbers(p.read("a")), numbers(p.read("b"))) == ([1, 3], [2, 4]) and len([n for n in listed(spark, p.folder) if n.startswith("stage")]) == 2


def test_one_of_two_writers_wins(spark, tmp_path):
    p = Publication(spark, f"file://{tmp_path}/pub")

    def slow(now):
        Publication(spark, p.folder).publish(lambda _: {"a": rows(spark, 1)}, ["a"])
        return {"a": rows(spark, 2)}

    with pytest.raises(Conflict):
        p.publish(slow, ["a"])
    assert (p.number(), numbers(p.read("a"))) == (1, [1])


def test_register(spark, tmp_path):
    p = Publication(spark, f"file://{tmp_path}/pub")
    items = lambda n, bad: [(1, f, ['{"id":"x"}'] if not bad or f else ['{"id":1}'], None, None) for f in range(n)]

    def fixtures(n, bad=False):
        f = spark.createDataFrame(items(n, bad), "source_id bigint, fixture int, i array<string>, e array<string>, error string")
        return f.withColumn("items", F.transform("i", J.variant)).withColumn("expected", F.transform("e", J.variant))

    source = spark.createDataFrame([(1, "shop")], "source_id bigint, key string")
    pages = spark.createDataFrame([(1, "u")], "source_id bigint, url string")
    assert register(p, source, CODE, fixtures(2), pages, SCHEMA)[0] is False  # too few
    assert register(p, source, CODE, fixtures(3, True), pages, SCHEMA)[0] is False and p.number() == 0
    with pytest.raises(ValueError, match="rejected"):
        register(p, source, "import os\n" + CODE, fixtures(3), pages, SCHEMA)
    assert register(p, source, CODE, fixtures(3), pages, SCHEMA)[0] is True
    assert register(p, source, CODE, fixtures(3), pages, SCHEMA)[0] is True
    assert sorted((r.id, r.status) for r in p.read("adapter").collect()) == [("1-1", "retired"), ("1-2", "active")]
    assert p.read("source").count() == 1 and p.read("fixture").count() == 2


def test_small_batches_leave_records_in_place(spark, tmp_path):
    at = lambda d: datetime(2024, 1, d)
    key = lambda i: (i % 3, f"k{i}")
    current = [(*key(i), f"p{i}", f"h{i}", at(1), at(2), 5, i % 4 != 0, None) for i in range(60)]
    spark.createDataFrame(current, "source_id bigint, external_key string, payload string, content_hash string, first_seen timestamp_ntz, last_seen timestamp_ntz, last_run_id bigint, is_active boolean, gone_at timestamp_ntz").write.parquet(f"{tmp_path}/r")
    c = spark.read.parquet(f"{tmp_path}/r").withColumn("id", F.lit("x"))
    batch = [(*key(i), f"q{i}", f"h{i}" if i % 2 else "new", at(3), i, 0, 9) for i in [*range(0, 80, 3), 3, 66]]
    b = spark.createDataFrame(batch, "source_id bigint, external_key string, payload string, content_hash string, seen_at timestamp_ntz, job_id bigint, item_idx int, run_id bigint")
    small = U.upsert_small(c, b)
    order = lambda d: sorted(map(repr, d.collect()))
    assert order(small) == order(U.upsert(c, b)) == order(U.upsert_small(c, b, most=3))
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
