"""Captures and the change feed as data sources."""

import gzip
import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from harrow.sources import connectors as C

AT = datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    C.register(spark)


def changes(spark, keys):
    d = spark.createDataFrame([(k, "insert", AT) for k in keys], "external_key string, kind string, created_at timestamp_ntz")
    return d.select(F.concat(F.lit("r"), "external_key").alias("record_id"), F.lit(1).cast("bigint").alias("source_id"), "external_key", "kind", "created_at")


def consume(spark, feed, consumer, out, **options):
    """One run of a consumer; what it has written so far."""
    s = spark.readStream.format("harrow_feed").options(path=feed, consumer=consumer, **options).load()
    s.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.id, r.external_key) for r in spark.read.schema(C.FEED).parquet(f"{out}/rows").collect())


def test_feed_has_two_consumers(spark, tmp_path):
    feed = f"file://{tmp_path}/feed"
    assert C.append_feed(changes(spark, "ba"), feed, ["external_key"]) == 2
    assert C.append_feed(changes(spark, []), feed, ["external_key"]) == 2
    a = consume(spark, feed, "a", str(tmp_path / "a"))
    assert a == [(1, "a"), (2, "b")]
    assert C.append_feed(changes(spark, "ced"), feed, ["external_key"]) == 5
    b = consume(spark, feed, "b", str(tmp_path / "b"))
    assert [i for i, _ in b] == [1, 2, 3, 4, 5]
    assert consume(spark, feed, "a", str(tmp_path / "a")) == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]
    assert consume(spark, feed, "a", str(tmp_path / "a")) == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]
    # A consumer of that name without its checkpoint goes on after what was committed for it at least.
    again = consume(spark, feed, "a", str(tmp_path / "a2"))
    assert set(again) <= {(3, "c"), (4, "d"), (5, "e")}
    assert spark.read.format("harrow_feed").option("path", feed).load().count() == 5


def test_empty_feed(spark, tmp_path):
    assert spark.read.format("harrow_feed").option("path", f"file://{tmp_path}/none").load().count() == 0


def test_no_captures(spark, tmp_path):
    assert spark.read.format("harrow_captures").option("path", f"file://{tmp_path}").load().count() == 0


def test_captures(spark, tmp_path):
    for site, files in (("x", {"1.gz": "eins", "2.gz": "ü"}), ("deep/y", {"1.gz": "three"})):
        folder = tmp_path / "c" / site
        folder.mkdir(parents=True)
        (folder / "manifest.json").write_text(json.dumps([{"url": f"{site}/{n}", "file": n, "status": 404 if n == "2.gz" else None} for n in files]))
        for n, text in files.items():
            (folder / n).write_bytes(gzip.compress(text.encode()))
    (tmp_path / "c" / "deep" / "notes.txt").write_text("no manifest here")
    d = spark.read.format("harrow_captures").option("path", f"file://{tmp_path}/c").load()
    assert sorted(map(tuple, d.collect())) == [("x", "x/1.gz", 200, "eins"), ("x", "x/2.gz", 404, "ü"), ("y", "deep/y/1.gz", 200, "three")]
    assert d.rdd.getNumPartitions() == 2


def test_feed_is_dealt_by_file(spark, tmp_path):
    """A folder of the feed is not one task, and what is asked for within files is all there, once."""
    path = f"{tmp_path}/feed"
    rows = [(f"r{i}", i, f"k{i}", "insert", datetime(2024, 1, 1) + timedelta(seconds=i)) for i in range(9000)]
    changes = spark.createDataFrame(rows, "record_id string, source_id long, external_key string, kind string, created_at timestamp_ntz")
    C.append_feed(changes.where("source_id < 4000"), path, ["created_at"])
    C.append_feed(changes.where("source_id >= 4000").repartition(3), path, ["created_at"])
    reader = C._FeedStream({"path": path})
    files = [f for d in Path(path).iterdir() for f in d.glob("*.parquet")]
    parts = reader.partitions({"id": 0}, {"id": 1 << 40})
    assert len(parts) == len(files) > 2
    got = [i for p in reader.partitions({"id": 1000}, {"id": 7000}) for b in reader.read(p) for i in b["id"].to_pylist()]
    assert sorted(got) == list(range(1001, 7001))
