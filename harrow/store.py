"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset and Spark runs on one machine (as in tests) a folder of our own."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(sc, "_harrow_root", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="harrow-")
            sc._harrow_root = base
            atexit.register(shutil.rmtree, base[7:], ignore_errors=True)
    return base.rstrip("/")


class _Made(threading.local):
    """The scratch paths of this thread, so that pipelines side by side leave each other's alone."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_made = _Made()


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; clean() removes it."""
    _made.paths.append(f"{shared_root(spark)}/harrow/{tag}-{uuid.uuid4().hex}")
    return _made.paths[-1]


def clean(spark: SparkSession) -> None:
    """Removes all scratch paths that this thread has made. Results that have not been written yet go with them."""
    while _made.paths:
        remove(spark, _made.paths.pop())


def made() -> int:
    """How many scratch paths there are: a mark for settled()."""
    return len(_made.paths)


def forget(spark: SparkSession, since: int) -> None:
    """Removes the scratch paths made since the mark."""
    while len(_made.paths) > since:
        remove(spark, _made.paths.pop())


def settled(df: DataFrame, tag: str, since: int) -> DataFrame:
    """df written and read back, and the scratch paths made since the mark removed, which it no longer needs."""
    out = written(df, tag)
    paths = _made.paths
    used, own = paths[since:-1], paths[-1]
    paths[since:] = [own]
    for path in used:
        remove(df.sparkSession, path)
    return out


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listed(spark: SparkSession, uri: str) -> list[str]:
    """The names in a folder, none where there is no folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []


def remove(spark: SparkSession, uri: str) -> None:
    """Deletes a scratch path through Hadoop's file systems."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch on its way to a Python worker. Spark's own bound is 64 MiB, which a worker holds several
#: times over; a batch still has one row at least, so a single longer text passes.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES (a setting of the session, lowered where it is higher)."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
