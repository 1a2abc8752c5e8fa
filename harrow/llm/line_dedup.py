"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased; only keys of at least
``least_chars`` code points count. The state is a folder and holds:

* signed postings (key, document, +1 or -1), appended by inserts and deletions, whose sums say which documents hold
  a key; tables of like size are merged, summed and without what has come to nothing, so that there are as many as the
  size has binary digits, however many changes there were;
* exact reference-count tables: how many documents hold a key and which is the largest, for the keys that at least
  ``least_docs`` documents hold. A change counts the keys it touches again and writes only what has changed; the
  tables of the last changes stand on top of each other and are merged from time to time;
* by shard of the key's hash, a cuckoo filter (Fan et al. 2014) of these keys. An insert or a deletion adds or removes
  just the keys that cross ``least_docs``, so deleting documents undoes their insertion.

Lines are looked up in the filter of their shard, and only those it holds go on to the exact table, which
settles false positives and names the document that keeps the line. A filter that fills up gets another of twice
its size behind it. All filters of a chain take the low bits of one hash for a key's place, so two keys that share
an entry of a larger filter share those of the smaller ones; deleting from the largest filter down therefore never
takes the last entry of a key that is still held. Filters are versioned files of the shared folder; a shard's
look-ups are dealt to as many salts as its share of all look-ups asks for, so that a very common line is spread over
tasks, each of which loads the one filter it needs. ``LineIndex.open`` takes a folder up again.

Defined results: a null or empty text is one empty line; rows with one id are one document, and null ids
together are a document smaller than all others; the largest id that holds a key keeps all its lines, in each
row of that id; deleting what was never inserted makes a key's sum negative, which counts as absent; an empty
table gives no rows. Ids may be of any type that has an order. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import remove
from .common import arrow_map, open_read, pieces, row_hash, scratch, text_bytes, write_bytes, written

BLANK = b" \t\n\x0b\f\r"
#: Count tables on top of each other before they are merged.
LAYERS = 8


class CuckooFilter:
    """Buckets of four 16-bit fingerprints. A key is a 64-bit hash: its low bits say where, its high ones what."""

    def __init__(self, capacity: int) -> None:
        self.mask = (1 << max(4, (int(capacity / 3.4)).bit_length())) - 1
        self.table = np.zeros((self.mask + 1, 4), np.uint16)
        self.rng = np.random.default_rng(7)

    def _places(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = (k.astype(np.uint64) >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        one = (k.astype(np.uint64) & np.uint64(self.mask)).astype(np.int64)
        return fp, one, one ^ self._step(fp)

    def _step(self, fp) -> np.ndarray:
        return ((np.asarray(fp, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & self.mask

    def contains(self, k: np.ndarray) -> np.ndarray:
        fp, one, two = self._places(k)
        return (self.table[one] == fp[:, None]).any(axis=1) | (self.table[two] == fp[:, None]).any(axis=1)

    def _fill(self, fp: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots of their places, all at once; says which found one."""
        order = np.argsort(place, kind="stable")
        sorted_place = place[order]
        rank = np.arange(len(place)) - np.searchsorted(sorted_place, sorted_place)
        free = self.table[sorted_place] == 0
        slot = (np.cumsum(free, axis=1) == (rank + 1)[:, None]) & free
        fits = slot.any(axis=1)
        self.table[sorted_place[fits], slot[fits].argmax(axis=1)] = fp[order[fits]]
        done = np.zeros(len(place), bool)
        done[order[fits]] = True
        return done

    def insert(self, k: np.ndarray) -> np.ndarray:
        """Adds the keys; says which found no room. Most find a free slot in one of their two places; only the
        rest push others around. A key that finds none is undone, so that no other key is lost, and those after
        it are refused with it: the filter is full."""
        fp, one, two = self._places(k)
        left = np.flatnonzero(~self._fill(fp, one))
        left = left[~self._fill(fp[left], two[left])]
        refused = np.zeros(len(k), bool)
        slots = memoryview(self.table.reshape(-1))
        steps: dict[int, int] = {}
        for n, (what, place) in enumerate(zip(fp[left].tolist(), one[left].tolist(), strict=True)):
            at, path, now = None, [], what
            while at is None and len(path) < 500:
                i = 4 * place + int(self.rng.integers(4))
                path.append((i, slots[i]))
                slots[i], now = now, slots[i]
                if now not in steps:
                    steps[now] = int(self._step(now))
                place ^= steps[now]
                at = next((i for i in range(4 * place, 4 * place + 4) if not slots[i]), None)
            if at is None:
                for i, was in reversed(path):
                    slots[i] = was
                refused[left[n:]] = True
                break
            slots[at] = now
        return refused

    def delete(self, k: np.ndarray) -> np.ndarray:
        """Removes an entry of each key; says which had one."""
        found = np.zeros(len(k), bool)
        slots = memoryview(self.table.reshape(-1))
        for n, (fp, one, two) in enumerate(zip(*map(np.ndarray.tolist, self._places(k)), strict=True)):
            at = next((i for place in (one, two) for i in range(4 * place, 4 * place + 4) if slots[i] == fp), None)
            if at is not None:
                slots[at] = 0
                found[n] = True
        return found


class FilterChain:
    """Cuckoo filters one behind the other, each larger than the one before."""

    def __init__(self, filters: list[CuckooFilter] | None = None) -> None:
        self.filters = filters or []

    def insert(self, k: np.ndarray) -> None:
        while len(k):
            if not self.filters:
                self.filters.append(CuckooFilter(max(64, len(k))))
            k = k[self.filters[-1].insert(k)]
            if len(k):
                self.filters.append(CuckooFilter(max(2 * 4 * len(self.filters[-1].table), len(k))))

    def delete(self, k: np.ndarray) -> None:
        for f in reversed(self.filters):
            k = k[~f.delete(k)]

    def contains(self, k: np.ndarray) -> np.ndarray:
        out = np.zeros(len(k), bool)
        for f in self.filters:
            out |= f.contains(k)
        return out

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, *[f.table for f in self.filters])
        return out.getvalue()

    @classmethod
    def load(cls, uri: str) -> FilterChain:
        with open_read(uri) as f:
            tables = np.load(io.BytesIO(f.read()))
        out = []
        for name in tables.files:
            c = CuckooFilter(1)
            c.table = tables[name]
            c.mask = len(c.table) - 1
            out.append(c)
        return cls(out)


def _keyed(text: bytes | None, least_chars: int) -> Iterator[tuple[bytes, bytes | None]]:
    """Each line and its key, or None where the key is too short."""
    for line in (text or b"").split(b"\n"):
        key = line.strip(BLANK).lower()
        long = len(key) >= least_chars and (key.isascii() or len(key.decode()) >= least_chars)
        yield line, key if long else None


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20) -> DataFrame:
    """(id, h, k1, k2): the distinct keys of every row, as 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in pieces(batches):
            found = [list({xxh3_128_digest(k) for _, k in _keyed(t, least_chars) if k is not None}) for t in text_bytes(b.column(2))]
            n = np.fromiter(map(len, found), np.int64, len(found))
            row = np.repeat(np.arange(len(found)), n)
            k = np.frombuffer(b"".join([x for f in found for x in f]), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(k[:, 0]), pa.array(k[:, 1])], ["id", "h", "k1", "k2"])

    rows = docs.select(F.col(id_col).alias("id"), row_hash(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, h bigint, k1 bigint, k2 bigint")


class LineIndex:
    """The state. shards: fixed for its life; about one to a million keys held by least_docs documents."""

    def __init__(self, spark: SparkSession, shards: int = 16, least_docs: int = 3, least_chars: int = 20, folder: str | None = None) -> None:
        self.spark, self.shards, self.least_docs, self.least_chars = spark, shards, least_docs, least_chars
        self.folder = folder or scratch(spark, "lines")
        self.version = 0  # of the last change
        self.layers: list[int] = []  # versions whose count tables stand on top of each other
        self.posts: list[list] = []  # tables of postings, [name, rows], the oldest and largest first

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineIndex:
        """The index a folder holds, as its last finished change left it."""
        with open_read(f"{folder}/manifest.json") as f:
            m = json.loads(f.read())
        index = cls(spark, m["shards"], m["least_docs"], m["least_chars"], folder)
        index.version, index.layers, index.posts = m["version"], m["layers"], m["posts"]
        return index

    def _save(self) -> None:
        """The manifest comes last: a change that was cut off has not happened, and its version is written anew."""
        m = {k: getattr(self, k) for k in ("shards", "least_docs", "least_chars", "version", "layers", "posts")}
        write_bytes(f"{self.folder}/manifest.json", iter([json.dumps(m).encode()]))

    def _read(self, kind: str, versions: list[int]) -> DataFrame:
        out = None
        for v in versions:
            df = self.spark.read.parquet(f"{self.folder}/{kind}-{v}").withColumn("v", F.lit(v))
            out = df if out is None else out.unionByName(df)
        return out

    def _postings(self, tables: list[list]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{name}" for name, _ in tables])

    def _merge(self) -> list[str]:
        """Merges the newest tables of postings as long as the one before is not twice as large; the names of those
        that are no longer needed once the manifest stands."""
        take, rows = 1, self.posts[-1][1]
        while take < len(self.posts) and self.posts[-take - 1][1] <= 2 * rows:
            rows += self.posts[-take - 1][1]
            take += 1
        if take == 1:
            return []
        old, name = self.posts[-take:], f"postings-{self.version}-merged"
        summed = self._postings(old).groupBy("k1", "k2", "id").agg(F.sum("by").alias("by")).where("by <> 0")
        summed.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        self.posts[-take:] = [[name, self.spark.read.parquet(f"{self.folder}/{name}").count()]]
        return [n for n, _ in old]

    def _put(self, df: DataFrame, kind: str, version: int) -> DataFrame:
        path = f"{self.folder}/{kind}-{version}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _layered(self) -> DataFrame:
        """k1, k2, n_docs, last: the uppermost row of each key, also of those that have fallen below least_docs."""
        all_ = self._read("counts", self.layers)
        if len(self.layers) == 1:
            return all_.drop("v")
        top = all_.groupBy("k1", "k2").agg(F.max_by(F.struct("n_docs", "last"), "v").alias("x"))
        return top.select("k1", "k2", "x.*")

    @property
    def counts(self) -> DataFrame:
        """k1, k2, n_docs, last of the keys in least_docs documents and more."""
        return self._layered().where(F.col("n_docs") >= self.least_docs)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: DataFrame | None = None) -> None:
        self._change(keys if keys is not None else line_keys(docs, id_col, text_col, self.least_chars), 1)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: DataFrame | None = None) -> None:
        """Takes documents out again; docs has them as they were inserted."""
        self._change(keys if keys is not None else line_keys(docs, id_col, text_col, self.least_chars), -1)

    def _shard(self) -> Column:
        return F.pmod(F.col("k1"), F.lit(self.shards)).cast("int")

    def _change(self, keys: DataFrame, by: int) -> None:
        v, enough = self.version + 1, F.col("n_docs") >= self.least_docs
        batch = self._put(keys.select("id", "k1", "k2").distinct().withColumn("by", F.lit(by).cast("long")), "postings", v)
        posts = [*self.posts, [f"postings-{v}", batch.count()]]
        count = lambda held: held.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("id").alias("last"))
        if not self.layers:
            now = self._put(count(batch.where("by > 0")).where(enough), "counts", v)
            moved = now.select("k1", "k2", F.lit(True).alias("add"))
        else:
            touched = written(batch.select("k1", "k2").distinct(), "touched")
            held = self._postings(posts).join(touched, ["k1", "k2"], "left_semi").groupBy("k1", "k2", "id").agg(F.sum("by").alias("by")).where("by > 0")
            was = self.counts.select("k1", "k2", F.lit(True).alias("was")).join(touched, ["k1", "k2"], "left_semi")
            now = touched.join(count(held), ["k1", "k2"], "left").join(was, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"), "last", F.coalesce("was", F.lit(False)).alias("was"))
            now = written(now.where(enough | F.col("was")), "now")
            self._put(now.drop("was"), "counts", v)
            moved = now.where(enough != F.col("was")).select("k1", "k2", enough.alias("add"))
        folder = self.folder
        moved = moved.withColumn("shard", self._shard())
        old = self._filters()
        moved = moved.join(old, "shard", "left") if old is not None else moved.withColumn("version", F.lit(None).cast("int"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = ((s, b.filter(pa.array(b.column(0).to_numpy() == s))) for b in batches for s in np.unique(b.column(0).to_numpy()).tolist())
            for shard, own in groupby(parts, key=lambda x: x[0]):
                t = pa.Table.from_batches([b for _, b in own])
                last = t.column("version")[0].as_py()
                chain = FilterChain.load(f"{folder}/filter-{shard}-{last}.npz") if last else FilterChain()
                k2, add = t.column("k2").to_numpy(), t.column("add").to_numpy()
                chain.delete(k2[~add])
                chain.insert(k2[add])
                write_bytes(f"{folder}/filter-{shard}-{v}.npz", iter([chain.dump()]))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([v], pa.int32())], ["shard", "version"])

        dealt = moved.select("shard", "version", "k2", "add").repartition(self.shards, "shard").sortWithinPartitions("shard", "k2")
        made = arrow_map(dealt, run, "shard int, version int")
        if old is not None:  # the list is whole, a row a shard
            made = old.select("shard", F.col("version").alias("before")).join(written(made, "filters"), "shard", "full_outer").select("shard", F.coalesce("version", "before").alias("version"))
        self._put(made, "files", v)
        self.version = v
        self.layers.append(v)
        self.posts = posts
        gone = self._merge()
        if len(self.layers) > LAYERS:
            merged = written(self.counts, "merged")
            self._put(merged, "counts", v)
            self.layers = [v]
        self._save()
        for name in gone:
            remove(self.spark, f"{self.folder}/{name}")

    def _filters(self) -> DataFrame | None:
        """shard, version: the file of its filter."""
        return self.spark.read.parquet(f"{self.folder}/files-{self.version}") if self.version else None

    def look_up(self, keys: DataFrame) -> DataFrame:
        """Rows of keys whose key may be in least_docs documents, by the filters alone."""
        folder, kind = self.folder, keys.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, chain = None, None  # one filter at a time: rows come by shard
            for b in batches:
                shard, version = b.column(4).to_numpy(), b.column(5).to_numpy()
                keep = np.zeros(b.num_rows, bool)
                for s in np.unique(shard).tolist():
                    at = np.flatnonzero(shard == s)
                    if s != now:
                        now, chain = s, FilterChain.load(f"{folder}/filter-{s}-{version[at[0]]}.npz")
                    keep[at] = chain.contains(b.column(3).to_numpy()[at])
                yield b.filter(pa.array(keep)).select([0, 1, 2, 3])

        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.shards)
        keyed = keys.select("id", "h", "k1", "k2", self._shard().alias("shard"))
        # A shard takes as many salts as its look-ups are tasks' worth, four times over so that they spread evenly.
        weight = written(keyed.groupBy("shard").agg(F.count("*").alias("n")).join(self._filters(), "shard"), "weights")
        fair = (weight.agg(F.sum("n").alias("n")).first()["n"] or 0) / n
        weight = weight.select("shard", "version", F.greatest(F.lit(1), F.ceil(F.col("n") * 4 / max(fair, 1.0))).cast("int").alias("salts"))
        # A shard without a filter has no key to find.
        dealt = keyed.join(weight, "shard").withColumn("salt", F.pmod(F.xxhash64("id", "h"), F.col("salts")))
        dealt = dealt.select("id", "h", "k1", "k2", "shard", "version", "salt").repartition(n, "shard", "salt").sortWithinPartitions("shard").drop("salt")
        return arrow_map(dealt, run, f"id {kind}, h bigint, k1 bigint, k2 bigint")

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: DataFrame | None = None, with_text: bool = False) -> DataFrame:
        """Per row: id, n_lines, n_dropped, kept_sha256 (of the kept lines), and kept if asked."""
        keys = keys if keys is not None else line_keys(docs, id_col, text_col, self.least_chars)
        drop = self.look_up(keys).join(self.counts, ["k1", "k2"]).where(~F.col("id").eqNullSafe(F.col("last")))
        drop = drop.select("id", "h", "k1", "k2").distinct().groupBy("id", "h").agg(F.collect_list(F.struct("k1", "k2")).alias("keys"))
        drop = drop.select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("keys.k1").alias("k1"), F.col("keys.k2").alias("k2"))
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        on = F.col("id").eqNullSafe(F.col("__id")) & (row_hash(F.col("text")) == F.col("__h"))
        joined = rows.join(drop, on, "left").select("id", "text", "k1", "k2")
        least = self.least_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from xxhash import xxh3_128_digest

            for b in pieces(batches):
                out = []
                for text, k1, k2 in zip(text_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    n = (text or b"").count(b"\n") + 1
                    kept = text or b""
                    left = n
                    if k1:
                        gone = {np.array(x, "<i8").tobytes() for x in zip(k1, k2, strict=True)}
                        lines = [line for line, key in _keyed(text, least) if key is None or xxh3_128_digest(key) not in gone]
                        kept, left = b"\n".join(lines), len(lines)
                    out.append((n, n - left, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([x[i] for x in out], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.string(), pa.string()])]], ["id", "n_lines", "n_dropped", "kept_sha256", "kept"])

        out = arrow_map(joined, run, f"id {rows.schema['id'].dataType.simpleString()}, n_lines bigint, n_dropped bigint, kept_sha256 string, kept string")
        return out if with_text else out.drop("kept")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 3, least_chars: int = 20, shard_keys: int = 1 << 20, with_text: bool = False) -> DataFrame:
    """A table deduplicated against itself through a fresh index."""
    keys = written(line_keys(docs, id_col, text_col, least_chars), "keys")
    index = LineIndex(docs.sparkSession, max(1, -(-keys.count() // shard_keys)), least_docs, least_chars)
    index.insert(docs, id_col, text_col, keys)
    return index.apply(docs, id_col, text_col, keys, with_text)
