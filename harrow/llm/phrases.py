"""Phrase collocations: word sequences that occur together more often than their parts would.

Texts lose the case of A-Z, are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``. A
candidate is a sequence of 2 to ``max_words`` words within a piece that occurs ``least`` times or more in its
language, overlaps included.

Counting takes two passes over the texts, in shards of about ``SHARD`` bytes.

1. Sketch. Every shard puts the hashes of its sequences (single words too) into 2**bits counters that stop at
   ``least``, and sends the counters it has touched, in slices. A slice's sum is an upper bound for each sequence; what
   goes on is one bit a counter: whether the bound reaches ``least``.
2. Scan. The sequences of a shard whose bit is set are its candidates: those of other shards cannot match in it. They
   compile into one Aho-Corasick automaton a language, each guarded by a blank on both sides, and the automaton
   counts all overlapping matches in the shard (single words are counted as they are numbered). Counts are summed over
   shards, and only sums of ``least`` or more stay.

A counter may let through too much, never too little, and the sums are of exact matches, so that the sketch's width
decides how much is shuffled and nothing else. It follows the input up to 2**``most_bits`` counters (32 MiB of bits
in a worker, and at most as much at the driver); with more sequences than that the filter passes more of them. A shard
ends inside a text where it must; the words it repeats from the shard before are taken off again.

Scores are exact: decimals of 38 digits hold a * a * 10**6 and l * r for counts up to 10**15.

Defined results: a null text is empty, a null language is ``und``; an empty table gives no rows; repeated rows count
each; equal scores are ordered by a (descending), then by the bytes of the phrase. Extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, parallelism, rough_bytes, text_bytes, written

#: Bytes of text a shard holds, counters a slice of the sketch has, and hashes that are sorted before they are sent.
SHARD, SLICE, HELD = 4 << 20, 1 << 18, 8 << 20
#: A-Z small, what splits pieces a line end, the tab a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
BREAK = 1
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Shard:
    """Some text as numbers of words. Bytes are taken as Latin-1, so that they stay what they are."""

    def __init__(self, lang: str, max_words: int, before: list[str]) -> None:
        """before: words that end the shard before, in a piece that goes on here."""
        self.lang, self.max_words, self.repeated = lang, max_words, len(before)
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.number[""], self.number["\n"]
        self.parts: list[np.ndarray] = []
        self.text: list[str] = []
        self.size = 0
        self.take(" ".join(before))

    def take(self, text: str) -> None:
        """More folded text, which ends where a word does."""
        tokens = text.replace("\n", " \n ").split(" ")
        ids = np.fromiter(map(self.number.__getitem__, tokens), np.int32, len(tokens))
        self.parts.append(ids[ids != 0])
        self.text.append(" ".join(filter(None, tokens)))
        self.size += len(text)

    def done(self) -> Shard:
        self.ids, self.words = np.concatenate(self.parts).astype(np.int64), list(self.number)
        self.parts = []
        return self

    def last(self) -> list[str]:
        """The words that the next shard repeats."""
        ids = self.ids[max(0, len(self.ids) - self.max_words + 1) :].tolist()
        after = max((i + 1 for i, x in enumerate(ids) if x == BREAK), default=0)
        return [self.words[i] for i in ids[after:]]

    def sequences(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: the starts of the sequences inside pieces, and their hashes. The words repeated from the
        shard before start no sequence that ended there."""
        own = np.fromiter((xxhash.xxh64_intdigest(w.encode("latin-1")) for w in self.words), np.uint64, len(self.words))
        own ^= np.uint64(xxhash.xxh64_intdigest(self.lang.encode()))
        own *= _K[1]
        h, good = np.zeros(len(self.ids), np.uint64), np.ones(len(self.ids), bool)
        for n in range(1, self.max_words + 1):
            m = len(self.ids) - n + 1
            if m <= 0:
                return
            h, good = h[:m], good[:m] & (self.ids[n - 1 :] != BREAK)
            h = (h ^ (h >> np.uint64(29))) * _K[0] + own[self.ids[n - 1 :]]
            at = np.flatnonzero(good)
            at = at[at + n > self.repeated]
            x = h[at]
            x = (x ^ (x >> np.uint64(32))) * _K[2]
            yield n, at, x ^ (x >> np.uint64(29))

    def phrases(self, n: int, at: np.ndarray) -> list[str]:
        """The distinct sequences of n words among those at the starts."""
        base, w = len(self.words), self.words
        if base**n < 1 << 63:
            key = self.ids[at]
            for j in range(1, n):
                key = key * base + self.ids[at + j]
            key = np.unique(key)
            parts = []
            for _ in range(n):
                key, part = np.divmod(key, base)
                parts.append(part)
            parts.reverse()
        else:  # ranks of beginnings in place of numbers that would not fit
            rank = self.ids[at]
            for j in range(1, n):
                rank = np.unique(rank * base + self.ids[at + j], return_inverse=True)[1]
            at = at[np.unique(rank, return_index=True)[1]]
            parts = [self.ids[at + j] for j in range(n)]
        return list(map(" ".join, zip(*[map(w.__getitem__, x.tolist()) for x in parts], strict=True)))

    def counted(self, phrases: list[str]) -> np.ndarray:
        """How often each phrase occurs, without those that the shard before has counted."""
        import ahocorasick

        if not phrases:
            return np.zeros(0, np.int64)
        found = ahocorasick.Automaton()
        for k, p in enumerate(phrases):
            found.add_word(f" {p} ", k)
        found.make_automaton()
        hits = lambda text: np.bincount(np.fromiter(map(itemgetter(1), found.iter(f" {text} ")), np.int32), minlength=len(phrases))
        n = hits(" ".join(filter(None, self.text)))
        return n - hits(self.text[0]) if self.repeated else n


def shards(lang: str, texts: list[bytes], max_words: int, size: int = SHARD) -> Iterator[Shard]:
    """Texts in shards of about size bytes; a longer one goes on in the next shard."""
    now, step = Shard(lang, max_words, []), max(1, min(size, 256 << 10))
    for t in texts:
        t, at = t.translate(FOLD).decode("latin-1"), 0
        while at < len(t):
            end = at + step
            if end < len(t):  # up to a blank or line end, so that no word is cut
                end = min([x for x in (t.find(" ", end), t.find("\n", end)) if x >= 0], default=len(t))
            now.take(t[at:end])
            at = end
            if now.size >= size:
                yield now.done()
                now = Shard(lang, max_words, now.last() if at < len(t) else [])
        now.take("\n")
    yield now.done()


def strings(values: list[str]) -> pa.Array:
    """Strings whose characters are the bytes of UTF-8."""
    ends = np.cumsum([0, *map(len, values)])
    return pa.LargeStringArray.from_buffers(len(values), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer("".join(values).encode("latin-1"))).cast(pa.string())


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    texts: dict[str, list[bytes]] = {}
    for lang, t in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
        texts.setdefault(lang, []).append(t)
    yield from texts.items()


def steps(bins: np.ndarray, most: int) -> bytes:
    """Sorted counter numbers below SLICE as steps of a byte each: 255 goes on without counting, and a counter that counts
    more than once, but no more often than most, comes again with a step of nought."""
    used, n = np.unique(bins, return_counts=True)
    again = np.minimum(n, most)
    full, rest = np.divmod(np.diff(used, prepend=0), 255)
    width = full + again
    out = np.zeros(int(width.sum()), np.uint8)
    first = np.cumsum(width) - width
    lead = np.repeat(first, full) + np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full)
    out[lead] = 255
    out[first + full] = rest
    return out.tobytes()


def added(counters: np.ndarray, blob: bytes, most: int) -> None:
    """Adds steps() to saturating counters."""
    step = np.frombuffer(blob, np.uint8)
    at = np.cumsum(step, dtype=np.int64)[step != 255]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    used, n = at[first], np.diff(first, append=len(at))
    counters[used] = np.minimum(counters[used] + n, most)


def sketch(texts: DataFrame, bits: int, least: int, max_words: int) -> np.ndarray:
    """A bit for every counter: whether what it has counted may hold a sequence that occurs least times. texts: lang, text."""
    slices = max(1, (1 << bits) // SLICE)
    width = (1 << bits) // slices

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        bins = np.sort(np.concatenate(parts))
        edges = np.searchsorted(bins, np.arange(slices + 1, dtype=np.int64) * width)
        used = np.flatnonzero(np.diff(edges))
        pack = zstandard.ZstdCompressor(level=1).compress
        blobs = [pack(steps(bins[edges[s] : edges[s + 1]].astype(np.int64) - s * width, least)) for s in used.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], ["slice", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            for lang, own in by_lang(b):
                for s in shards(lang, own, max_words):
                    held += [(h >> np.uint64(64 - bits)).astype(np.uint32) for _, _, h in s.sequences()]
                    if sum(map(len, held)) > HELD:
                        yield packed(held)
                        held = []
        if any(map(len, held)):
            yield packed(held)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counters = None, None
        unpack = zstandard.ZstdDecompressor().decompress
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(counters >= least).tobytes()], pa.binary())], ["slice", "bits"])
        for b in batches:
            for s, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s != now:
                    if now is not None:
                        yield done()
                    now, counters = s, np.zeros(width, np.int64)
                added(counters, unpack(blob), least)
        if now is not None:
            yield done()

    dealt = arrow_map(texts, run, "slice int, blob binary").repartition(min(slices, 4 * parallelism(texts.sparkSession)), "slice").sortWithinPartitions("slice")
    out = np.zeros((slices, -(-width // 8)), np.uint8)
    for r in arrow_map(dealt, sums, "slice int, bits binary").collect():  # 2**bits bits at most
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def sequence_counts(docs: DataFrame, max_words: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text", most_bits: int = 28) -> DataFrame:
    """lang, words, phrase, f: every sequence of up to max_words words that occurs least times or more, and for each
    language a row of no words whose f counts all words. Read from a scratch table."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where(F.col("text") != "")
    size = rough_bytes(docs) or docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long")).alias("n")).first()["n"] or 0
    bits = min(most_bits, max(12, int(size).bit_length() - 2))
    passed = texts.sparkSession.sparkContext.broadcast(sketch(texts, bits, least, max_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shift = passed.value, np.uint64(64 - bits)
        for b in batches:
            for lang, own in by_lang(b):
                for s in shards(lang, own, max_words):
                    single = np.bincount(s.ids[s.repeated :], minlength=len(s.words))
                    single[:2] = 0
                    phrases, sizes, counts = [""], [1], [[single.sum()]]
                    for n, at, h in s.sequences():
                        k = h >> shift
                        at = at[(known[k >> np.uint64(3)] >> (np.uint64(7) - (k & np.uint64(7))).astype(np.uint8)) & 1 == 1]
                        if n == 1:  # single words need no automaton
                            ids = np.unique(s.ids[at])
                            counts.append(single[ids])
                            phrases += [s.words[i] for i in ids.tolist()]
                        else:
                            phrases += s.phrases(n, at)
                        sizes.append(len(phrases) - sum(sizes))
                    own_words = sum(map(len, counts))
                    counts.append(s.counted(phrases[own_words:]))
                    words = pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, strings(phrases), pa.array(np.concatenate(counts), pa.int64())], ["lang", "words", "phrase", "f"])

    found = arrow_map(texts, run, "lang string, words int, phrase string, f bigint")
    sums = found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return written(sums.where((F.col("f") >= least) | (F.col("words") == 0)), "phrases")


def _part(start: int | str, size: int | str) -> str:
    return f"array_join(slice(w, {start}, {size}), ' ')"


def scored(counts: DataFrame, max_words: int = 3, share: int = 50) -> DataFrame:
    """lang, phrase, words, a, l, r, score: the candidates that no longer one explains. counts: as sequence_counts()."""
    wide = "decimal(38,0)"
    cands = counts.where("words >= 2").select("lang", "phrase", F.col("words").alias("m"), F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = cands.select("lang", "phrase", "m", "a", "w", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "m", "a", "k", F.expr(_part(1, "k")).alias("first"), F.expr(_part("k + 1", "m - k")).alias("rest"))
    parts = counts.where(F.col("words").between(1, max_words - 1))
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    a, one = F.col("a").cast("decimal(19,0)"), F.lit(1_000_000).cast("decimal(7,0)")
    joined = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    joined = joined.withColumns({"top": (a * a * one).cast(wide), "under": (F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")).cast(wide)})
    joined = joined.withColumn("score", F.expr("top div under"))
    least = joined.groupBy("lang", "phrase", "m", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = cands.where("m > 2").select("lang", F.col("a").alias("f"), F.explode(F.flatten(F.expr(f"transform(sequence(2, m - 1), n -> transform(sequence(1, m - n + 1), i -> {_part('i', 'n')}))"))).alias("phrase"))
    longest = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = least.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100).cast("decimal(7,0)") * F.col("longer") < F.lit(share).cast("decimal(7,0)") * F.col("a")))
    return kept.select("lang", "phrase", F.col("m").alias("words"), "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, share: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text", most_bits: int = 28) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases."""
    counts = sequence_counts(docs, max_words, least, lang_col, text_col, most_bits)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(counts, max_words, share).withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))  # a row a language
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
