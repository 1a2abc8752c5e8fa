"""Removal of repeated word windows by super-k-mer partitioning.

A window is ``size`` consecutive words. Its minimiser is the least hash among its runs of ``gram`` words, and
consecutive windows with one minimiser form a super-k-mer: one string of words that stands for all of them.
Super-k-mers go to the bucket of their minimiser, where all equal windows of the corpus meet; there the windows
are unpacked, sorted by two 64-bit hashes (of the 64-bit hashes of their words) and document id, and every window
that a smaller id also has is a hit. Words under hits are removed.

Transport. A reduce task counts several buckets, more of them the larger the input is, at most ``most_tasks`` tasks in
all. Map tasks pack the super-k-mers of a reduce task together into Zstandard blobs, whatever their buckets, so that
blobs stay worth packing where a map task has hardly a string for each bucket. The reduce task unpacks them into rows,
which Spark sorts by bucket and spills where they are many; then it holds one bucket at a time. A lost executor costs its
tasks.

Skew. A task sends a super-k-mer once; when it meets the same string again in a larger id, that is a hit
already and only its place is sent on. So copies and shared passages cost a bucket about one string a task, however
many documents hold them. Buckets of over ``hot`` times the usual size (a minimiser at the edge of a common
passage, with different words around) are dealt window by window, by the hash of the whole window. Which these are is
counted on a share of the documents, ``sample``; it decides only where windows meet, not what is found.

Defined results: null and short texts have no windows; equal ids never hit each other; a null id is smaller
than all others; repeated rows are judged alike; an empty table gives no rows. Ids that are no integers are ranked
first, which costs a join of the texts with their ranks. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..operators.tables import sequenced
from .common import arrow_map, pieces, row_hash, text_bytes, written

NONE = -(2**63)
SEEN = 200_000  # strings a task remembers
FLUSH = 256 << 10  # bytes of a blob before packing
HELD = 48 << 20  # bytes of all strings a task holds
TASK_BUCKETS = 4  # a reduce task's buckets, until there are most_tasks of them
PACKED = "part int, blob binary, id bigint, h bigint, first int, windows int"
STRINGS = "bucket bigint, string binary, id bigint, h bigint, first int, windows int"
_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(1, 2**63, (3, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _runs(h: np.ndarray, n: int, factors: np.ndarray) -> np.ndarray:
    """A hash of every n consecutive entries."""
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for j in range(n):
        out += h[j : j + len(out)] * factors[j]
    return out ^ (out >> np.uint64(29))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Packer:
    """Collects strings by reduce task and packs them into rows; hits that it finds itself are rows without a blob."""

    def __init__(self, parts: int) -> None:
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=5)
        self.parts = parts
        self.open: dict[int, list[tuple]] = defaultdict(list)
        self.bytes: dict[int, int] = defaultdict(int)
        self.held = self.ready = 0
        self.rows: list[tuple] = []
        self.seen: dict[bytes, int] = {}

    def add(self, bucket: int, string: bytes, key: int, h: int, first: int, windows: int) -> None:
        from xxhash import xxh3_128_digest

        mark = xxh3_128_digest(string)
        least = self.seen.get(mark)
        if least is not None and key > least:
            self.rows.append((hash((key, h, first)) % self.parts, None, key, h, first, windows))
            self.ready += 64
            return
        if len(self.seen) >= SEEN:
            self.seen.clear()
        self.seen[mark] = key if least is None else min(key, least)
        turn, part = divmod(bucket, self.parts)
        self.open[part].append((string, turn, key, h, first, windows))
        self.bytes[part] += len(string) + 36
        self.held += len(string) + 36
        if self.bytes[part] >= FLUSH:
            self.flush(part)
        if self.held >= HELD:
            for x in list(self.open):
                self.flush(x)

    def flush(self, part: int) -> None:
        got = self.open.pop(part)
        self.held -= self.bytes.pop(part)
        strings, turns, keys, hs, firsts, windows = zip(*got, strict=True)
        # Keys as steps: a task goes through small ids first, so most steps are small.
        head = [np.int64(len(got)), np.array(turns, np.int64), np.diff(np.array(keys, np.int64), prepend=0), np.array(hs, np.int64), np.array(firsts, np.int32), np.array(windows, np.int32)]
        blob = self.pack.compress(b"".join([x.tobytes() for x in head]) + b"\n".join(strings) + b"\n")
        self.rows.append((part, blob, None, None, None, None))
        self.ready += len(blob)

    def batch(self, end: bool = False) -> Iterator[pa.RecordBatch]:
        """The rows that are ready, some megabytes at a time."""
        if end:
            for x in list(self.open):
                self.flush(x)
        if self.rows and (end or self.ready >= 4 << 20):
            types = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            for i in range(0, len(self.rows), 20_000):
                part = self.rows[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(types)], ["part", "blob", "id", "h", "first", "windows"])
            self.rows, self.ready = [], 0


def _unpack(blob: bytes, part: int, parts: int) -> pa.RecordBatch:
    """The strings of a blob as rows, each string with a line end."""
    import zstandard

    plain = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(plain, np.int64, 1)[0])
    wide, narrow = np.frombuffer(plain, np.int64, 3 * n, 8).reshape(3, n), np.frombuffer(plain, np.int32, 2 * n, 8 + 24 * n).reshape(2, n)
    text = memoryview(plain)[8 + 32 * n :]
    ends = np.zeros(n + 1, np.int32)
    ends[1:] = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1  # words hold no line end
    strings = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(text)])
    columns = [pa.array(wide[0] * parts + part), strings, pa.array(np.cumsum(wide[1])), *[pa.array(x) for x in (wide[2], *narrow)]]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "string", "id", "h", "first", "windows"])


def _superkmers(b: pa.RecordBatch, size: int, gram: int, buckets: int) -> Iterator[tuple[int, bytes, int, int, int, int]]:
    """(bucket, string, key, h, first window, windows) of a batch of key, h, text."""
    keys, hs, counts = [], [], []
    words: list[bytes] = []
    rows = zip([NONE if k is None else k for k in b.column(0).to_pylist()], b.column(1).to_pylist(), text_bytes(b.column(2)), strict=True)
    for key, h, text in sorted(rows, key=itemgetter(0)):  # small ids first: then the others' copies are hits at once
        own = (text or b"").split()
        if len(own) >= size:
            keys.append(key)
            hs.append(h)
            counts.append(len(own))
            words += own
    if not keys:
        return
    n = len(words)
    line = b" ".join(words)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=at[1:])
    doc = np.repeat(np.arange(len(keys)), counts)
    begin = np.concatenate([[0], np.cumsum(counts)])
    g = _runs(_hashes(words), gram, FACTORS[0])
    del words
    least = g[: n - size + 1].copy()
    for j in range(1, size - gram + 1):
        np.minimum(least, g[j : j + len(least)], out=least)
    i = np.flatnonzero(doc[: len(least)] == doc[size - 1 :])
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1] + 1) | (least[i[1:]] != least[i[:-1]])
    starts = i[new]
    ends = np.append(i[np.flatnonzero(new)[1:] - 1], i[-1])
    bucket = (_mix(least[starts]) % np.uint64(buckets)).tolist()
    d = doc[starts]
    first = (starts - begin[d]).tolist()
    for k, a, z, x, f, c in zip(bucket, at[starts].tolist(), (at[ends + size] - 1).tolist(), d.tolist(), first, (ends - starts + 1).tolist(), strict=True):
        yield k, line[a:z], keys[x], hs[x], f, c


def hot_buckets(rows: DataFrame, size: int, gram: int, buckets: int, most: float) -> dict[int, int]:
    """The buckets of more than most windows, and how many parts of that size they make. rows: key, h, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Counter()
        for b in pieces(batches, 256):
            for bucket, _, _, _, _, windows in _superkmers(b, size, gram, buckets):
                n[bucket] += windows
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["bucket", "n"])

    n = arrow_map(rows, run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    return {r["bucket"]: -int(-r["n"] // most) for r in n.collect()}  # fewer than windows / most


def pack_documents(rows: DataFrame, size: int, gram: int, buckets: int, hot: dict[int, int], parts: int) -> DataFrame:
    """The blobs of the super-k-mers of rows (key, h, text) for each of the reduce tasks, and hits found on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Packer(parts)
        for b in pieces(batches, 256):
            for bucket, string, key, h, first, windows in _superkmers(b, size, gram, buckets):
                if bucket not in hot:
                    p.add(bucket, string, key, h, first, windows)
                    continue
                words = string.split(b" ")
                own = _mix(_runs(_hashes(words), size, FACTORS[1])) % np.uint64(hot[bucket])
                for j in range(windows):
                    p.add(((bucket + 1) << 24) + int(own[j]), b" ".join(words[j : j + size]), key, h, first + j, 1)
            yield from p.batch()
        yield from p.batch(end=True)

    return arrow_map(rows, run, PACKED)


def unpacked(packed: DataFrame, parts: int) -> DataFrame:
    """The strings in the blobs, a row each; hits found on the way keep their rows, without bucket and string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            is_blob = pc.is_valid(b.column(1))
            hits, blobs = b.filter(pc.invert(is_blob)), b.filter(is_blob)
            none = [pa.nulls(hits.num_rows, t) for t in (pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, *hits.columns[2:]], ["bucket", "string", "id", "h", "first", "windows"])
            for part, blob in zip(blobs.column(0).to_pylist(), blobs.column(1), strict=True):
                yield _unpack(blob.as_py(), part, parts)

    return arrow_map(packed, run, STRINGS)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """The word hashes and numbers (key, h, first, windows) of each bucket in turn; strings come sorted by bucket."""
    now, hashes, numbers = None, [], []
    for b in batches:
        if not b.num_rows:
            continue
        buckets = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), b.num_rows]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if buckets[i] != now and hashes:
                yield hashes, numbers
                hashes, numbers = [], []
            now = buckets[i]
            hashes.append(_hashes(b"".join(b.column(1)[i:j].to_pylist()).split()))
            numbers.append(np.stack([c[i:j].to_numpy().astype(np.int64) for c in b.columns[2:]]))
    if hashes:
        yield hashes, numbers


def count_buckets(strings: DataFrame, size: int) -> DataFrame:
    """Hits of each bucket: id, h, first, last (windows). strings: as unpacked() has them, sorted by bucket in each
    partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes: list[pa.RecordBatch] = []

        def own() -> Iterator[pa.RecordBatch]:
            for b in batches:
                is_string = pc.is_valid(b.column(1))
                found = b.filter(pc.invert(is_string))
                last = pc.subtract(pc.add(found.column(4), found.column(5)), pa.scalar(1, pa.int32()))
                notes.append(pa.RecordBatch.from_arrays([*found.columns[2:5], last], ["id", "h", "first", "last"]))
                yield b.filter(is_string)

        for hashes, numbers in _by_bucket(own()):
            yield from notes
            notes.clear()
            keys, hs, firsts, windows = np.concatenate(numbers, axis=1)
            h = np.concatenate(hashes)
            lengths = windows + size - 1
            string = np.repeat(np.arange(len(keys)), lengths)
            i = np.flatnonzero(string[: len(h) - size + 1] == string[size - 1 :])
            a, z = _runs(h, size, FACTORS[1])[i], _runs(h, size, FACTORS[2])[i]
            string = string[i]
            key = keys[string]
            order = np.lexsort((key, z, a))
            a, z = a[order], z[order]
            new = np.ones(len(order), bool)
            new[1:] = (a[1:] != a[:-1]) | (z[1:] != z[:-1])
            sorted_key = key[order]
            least = sorted_key[new][np.cumsum(new) - 1]
            hit = np.zeros(len(order), bool)
            hit[order] = sorted_key > least
            # Runs of hits within a string.
            place = i - (np.cumsum(lengths) - lengths)[string] + firsts[string]
            j = np.flatnonzero(hit)
            if not len(j):
                continue
            new = np.ones(len(j), bool)
            new[1:] = (j[1:] != j[:-1] + 1) | (string[j[1:]] != string[j[:-1]])
            s = j[new]
            e = np.append(j[np.flatnonzero(new)[1:] - 1], j[-1])
            own = string[s]
            yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array(hs[own]), pa.array(place[s].astype(np.int32)), pa.array(place[e].astype(np.int32))], ["id", "h", "first", "last"])

        yield from notes

    return arrow_map(strings, run, "id bigint, h bigint, first int, last int")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (a long in the order of the ids), h (tells rows of one id apart; zero where no id is repeated), text."""
    ids = docs.select(F.col(id_col).alias("id"))
    repeated = not ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    rows = docs.select(F.col(id_col).alias("id"), (row_hash(F.col(text_col)) if repeated else F.lit(0).cast("long")).alias("h"), F.col(text_col).alias("text"))
    if isinstance(rows.schema["id"].dataType, IntegralType):
        return rows.withColumn("key", F.col("id").cast("long"))
    ranks = sequenced(ids.where("id is not null").distinct().withColumnRenamed("id", "name"), ["name"]).select("name", F.col("id").alias("key"))
    return written(rows.join(ranks, F.col("id") == F.col("name"), "left").drop("name"), "keyed")


def repeated_windows(rows: DataFrame, size: int = 13, gram: int = 3, bucket_windows: int = 400_000, hot: int = 4, sample: float = 1 / 16, sample_docs: int = 200_000, most_tasks: int = 20_000) -> DataFrame:
    """(key, h, first, last): runs of windows that a smaller key has too. rows: key long, h, text. A null key is
    shown as the least long. sample: the share of documents that hot buckets are counted on, of sample_docs at most.
    most_tasks: the reduce tasks at most; beyond them a task gets more buckets, and still holds one at a time."""
    total = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("chars"), F.count("*").alias("n")).first()
    buckets = max(1, (total["chars"] or 0) // (6 * bucket_windows))
    rows = rows.select("key", "h", "text")
    share = min(sample, sample_docs / max(total["n"], 1))
    some = rows.where(F.xxhash64("key", "h") < -(2**63) + int(share * 2.0**64)) if share < 1 else rows
    over = hot_buckets(some, size, gram, buckets, hot * bucket_windows * share) if buckets > 1 else {}
    # Sized by the text, so that a task's load does not grow with it. Buckets are dealt in turn, not by a hash, so that no
    # task gets more than others.
    tasks = max(1, min(buckets, rows.sparkSession.sparkContext.defaultParallelism), min(most_tasks, buckets // TASK_BUCKETS))
    packed = pack_documents(rows, size, gram, buckets, over, tasks)
    strings = unpacked(packed.repartitionById(tasks, F.col("part")), tasks)
    hits = count_buckets(strings.sortWithinPartitions("bucket"), size)
    return written(hits.withColumnRenamed("id", "key").distinct(), "hits")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13, with_text: bool = False, **params) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 (of the kept words, one blank between), and kept if asked."""
    rows = _keyed(docs, id_col, text_col)
    hits = repeated_windows(rows, size, **params)
    spans = hits.groupBy("key", "h").agg(F.collect_list(F.struct("first", "last")).alias("spans")).select(F.col("key").alias("__key"), F.col("h").alias("__h"), "spans")
    on = (F.coalesce("key", F.lit(NONE)) == F.col("__key")) & (F.col("h") == F.col("__h"))
    joined = rows.join(spans, on, "left").select("id", "text", F.col("spans.first").alias("first"), F.col("spans.last").alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = []
            for text, first, last in zip(text_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = (text or b"").split()
                kept = words
                if first:
                    gone = np.zeros(len(words) + 1, np.int32)
                    np.add.at(gone, first, 1)
                    np.add.at(gone, np.array(last) + size, -1)
                    kept = [w for w, x in zip(words, np.cumsum(gone).tolist(), strict=False) if not x]
                line = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(line).hexdigest(), line.decode() if with_text else None))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([x[i] for x in out], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.string(), pa.string()])]], ["id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = arrow_map(joined, run, f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    return out if with_text else out.drop("kept")
