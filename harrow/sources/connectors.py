"""Captured responses and the change feed as sources of Spark: ``spark.read.format`` and ``spark.readStream.format``.

``register(spark)`` makes both known to a session.

* ``harrow_captures`` (batch): every folder under the path that has a manifest, a partition each. The driver lists
  folders and reads no manifest; a task reads its folder's and opens one body at a time.
* ``harrow_feed`` (stream and batch): the change feed as ``append_feed`` writes it, whose offsets are event ids. A batch of
  the stream takes the ids after the last one up to the newest, a file of the feed a partition. When Spark has
  committed a batch, the consumer's position is written beside the feed: an event counts as consumed by a consumer once the
  position has passed it, and is handed over again if a consumer stops before that.
"""

from __future__ import annotations

import gzip
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.tables import sequenced
from ..store import listed

CAPTURES = "folder string, url string, status int, body string"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _names(uri: str) -> list[tuple[str, bool]]:
    """Names in a folder, and whether they are folders."""
    from pyarrow import fs

    store, path = _fs(uri)
    return [(i.base_name, i.type == fs.FileType.Directory) for i in store.get_file_info(fs.FileSelector(path, allow_not_found=True))]


def _bytes(uri: str) -> bytes:
    store, path = _fs(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


class _Folder(InputPartition):
    def __init__(self, uri: str) -> None:
        self.uri = uri


class _Captures(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[InputPartition]:
        out, todo = [], [self.path]
        while todo:
            at = todo.pop()
            names = _names(at)
            if ("manifest.json", False) in names:
                out.append(_Folder(at))
            todo += [f"{at}/{n}" for n, folder in sorted(names, reverse=True) if folder]
        return out

    def read(self, partition: _Folder | None) -> Iterator[tuple]:
        if partition is None:  # Spark's stand-in where there are no partitions
            return
        for entry in json.loads(_bytes(f"{partition.uri}/manifest.json")):
            raw = _bytes(f"{partition.uri}/{entry['file']}")
            body = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
            status = entry.get("status")
            yield partition.uri.rpartition("/")[2], entry.get("url"), 200 if status is None else int(status), body.decode("utf-8", "replace")


class Captures(DataSource):
    """option path: a folder; rows of all manifests in it and below."""

    @classmethod
    def name(cls) -> str:
        return "harrow_captures"

    def schema(self) -> str:
        return CAPTURES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Captures(self.options)


FEED = "id bigint, record_id string, source_id bigint, external_key string, kind string, created_at timestamp_ntz"
_PART = re.compile(r"ids=(\d+)-(\d+)$")


def _feed_parts(path: str) -> list[tuple[int, int, str]]:
    return sorted((int(m[1]), int(m[2]), f"{path}/{n}") for n, folder in _names(path) if folder and (m := _PART.match(n)))


class _Range(InputPartition):
    def __init__(self, uri: str, after: int, upto: int) -> None:
        self.uri, self.after, self.upto = uri, after, upto


class _Feed:
    """What reading the feed once and as a stream have in common."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.consumer = options["path"].rstrip("/"), options.get("consumer", "default")

    def _ranges(self, after: int, upto: int) -> list[InputPartition]:
        folders = [uri for first, last, uri in _feed_parts(self.path) if first <= upto and last > after]
        return [_Range(f"{uri}/{n}", after, upto) for uri in folders for n, folder in _names(uri) if not folder and n.endswith(".parquet")]

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        if partition is None:  # Spark's stand-in where there are no partitions
            return

        store, path = _fs(partition.uri)
        names = [c.split()[0] for c in FEED.split(", ")]
        with store.open_input_file(path) as f:
            # No reading ahead, a small buffer a column: a dataset's scan would hold several files' row groups.
            for b in pq.ParquetFile(f, buffer_size=1 << 20, pre_buffer=False).iter_batches(4096, columns=names, use_threads=False):
                b = b.filter((pc.field("id") > partition.after) & (pc.field("id") <= partition.upto)).select(names)
                if b.num_rows:
                    yield b


class _FeedReader(_Feed, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self._ranges(0, 1 << 62)


class _FeedStream(_Feed, DataSourceStreamReader):
    def _after(self) -> int:
        """Where the consumer stands."""
        return max((int(n) for n, _ in _names(f"{self.path}/consumers/{self.consumer}") if n.isdigit()), default=0)

    def initialOffset(self) -> dict:
        return {"id": self._after()}

    def latestOffset(self) -> dict:
        return {"id": max((last for _, last, _ in _feed_parts(self.path)), default=self._after())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self._ranges(start["id"], end["id"])

    def commit(self, end: dict) -> None:
        store, path = _fs(f"{self.path}/consumers/{self.consumer}")
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{end['id']}") as f:
            f.write(b"")


class Feed(DataSource):
    """options path and consumer (a name with a position of its own)."""

    @classmethod
    def name(cls) -> str:
        return "harrow_feed"

    def schema(self) -> str:
        return FEED

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FeedReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _FeedStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Captures)
    spark.dataSource.register(Feed)


def append_feed(changes: DataFrame, path: str, order: list[str]) -> int:
    """Appends changes (record_id, source_id, external_key, kind, created_at) to the feed, with ids counted on in the given
    order; the folder appears whole, under the ids it holds. Returns the newest id. One writer at a time."""
    spark, path = changes.sparkSession, path.rstrip("/")
    newest = max((int(m[2]) for n in listed(spark, path) if (m := _PART.match(n))), default=0)
    rows = sequenced(changes, order, newest).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in FEED.split(", ")])
    stage = f"{path}/.stage-{uuid.uuid4().hex}"
    rows.write.parquet(stage)
    n = spark.read.schema(FEED).parquet(stage).count()
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = jvm.Path(stage).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not n:
        fs.delete(jvm.Path(stage), True)
        return newest
    if not fs.rename(jvm.Path(stage), jvm.Path(f"{path}/ids={newest + 1}-{newest + n}")):
        raise OSError(f"another writer has appended to {path}")
    return newest + n
