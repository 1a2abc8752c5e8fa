"""Benchmark decontamination by winnowing (Schleimer, Wilkerson, Aiken 2003), in DataFrame operations only.

A window is ``span`` consecutive words of a benchmark item (an item of fewer words is one window of its own).
Of each text the k-gram hashes are taken, and in every window the least of its span - k + 1 hashes is kept. Two texts
that share a window therefore share a kept hash, so the join of document and benchmark fingerprints misses nothing.
Consecutive windows that keep the same hash make one fingerprint row, which knows its windows and carries their
word hashes. Items shorter than a window have one fingerprint, the hash of all their words; against these, every
gram of that length counts on the document side.

Texts are read once and never shuffled. A bitmap of the benchmark's fingerprints (one row, ``bitmap_bits`` at most)
goes to all tasks and drops nearly all fingerprint rows where they arise; it only spares work, as the exact join
follows. What matches is extended: its windows are joined with the benchmark's on two 64-bit hashes of their word
hashes, and the hit words are the union of the matching windows.

Benchmark fingerprints and windows are broadcast when their count is at most ``broadcast_rows``; beyond that
the joins shuffle, with Spark's skew handling, and the result is the same.

Defined results: null or wordless texts have no words and no hits; null or wordless items have no windows and
null item ids are not listed, though their windows hit. Rows alike in id and text each get their own row out.
The digest of no items is that of the empty string. Extra columns are not read, and passed on by
``decontaminate``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free, row_hash, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _grams(hashes: str, n: int, salt: int | None = None) -> Column:
    """Hashes of all runs of n word hashes."""
    of = lambda i: F.xxhash64(*([F.lit(salt)] if salt is not None else []), *[F.get(hashes, i + j) for j in range(n)])
    return F.when(F.size(hashes) >= n, F.transform(F.sequence(F.lit(0), F.size(hashes) - n), of)).otherwise(F.array().cast("array<bigint>"))


def _hashed(df: DataFrame, text: Column, *keep: Column) -> DataFrame:
    return df.select(*keep, word_array(text).alias("words")).select(*[c for c in df.select(*keep).columns], F.size("words").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("hs"))


def _least(gs: str, run: int) -> Column:
    """The least hash of every window."""
    return F.transform(F.slice(gs, 1, F.greatest(F.size(gs) - run + 1, F.lit(0))), lambda x, i: F.least(x, *[F.get(gs, i + j) for j in range(1, run)]))


def _entry(pos: Column | int, windows: Column | int, n: int, fp: Column) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.struct(as_col(pos).alias("pos"), as_col(windows).alias("windows"), F.lit(n).alias("n"), fp.alias("fp"))


def _fingerprinted(df: DataFrame, span: int, k: int, short: list[int]) -> DataFrame:
    """df (with hs) with entries: the fingerprint rows of each text. The first, at position -1, stands for the row."""
    least = df.withColumn("gs", _grams("hs", k)).withColumn("least", _least("gs", span - k + 1)).drop("gs")
    at = least.withColumn("at", F.array_compact(F.transform("least", lambda x, i: F.when((i == 0) | (x != F.get("least", i - 1)), i))))
    own = F.transform("at", lambda s, j: _entry(s, F.coalesce(F.get("at", j + 1), F.size("least")) - s, span, F.get("least", s)))
    whole = lambda n: F.transform(_grams("hs", n, n), lambda g, i: _entry(i, 1, n, g))
    return at.withColumn("entries", F.concat(F.array(_entry(-1, 0, 0, F.lit(0).cast("long"))), own, *map(whole, short))).drop("least", "at")


def _bitmap(marks: DataFrame, bits: int) -> DataFrame:
    """One row: an array of longs, with a bit set for the low bits of each fp."""
    place = F.col("fp").bitwiseAND(F.lit(bits - 1).cast("long"))
    words = marks.select(F.shiftright(place, 6).alias("id"), F.expr("shiftleft(1L, cast(fp & 63 as int))").alias("w")).groupBy("id").agg(F.bit_or("w").alias("w"))
    dense = marks.sparkSession.range(bits // 64).join(words, "id", "left").select(F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w")).alias("x"))
    return dense.agg(F.sort_array(F.collect_list("x"))["w"].alias("bits"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    span: int = 10,
    k: int = 5,
    broadcast_rows: int = 200_000,
    bitmap_bits: int = 1 << 26,
) -> DataFrame:
    """Per row of docs: id, h (hash of its text), n_words, n_hit, n_items (long), items (sorted strings),
    contaminated."""
    items = written(_hashed(benchmark, F.col(item_text_col), F.col(item_col).alias("item")).where("n_words > 0"), "items")
    short = sorted(r["n_words"] for r in items.where(F.col("n_words") < span).select("n_words").distinct().collect())  # span - 1 at most

    def windows(hs: str, n: int) -> Column:
        both = lambda i: F.struct(F.xxhash64(*[F.get(hs, i + j) for j in range(n)]).alias("w1"), F.xxhash64(F.lit(7), *[F.get(hs, i + j) for j in range(n)]).alias("w2"))
        return F.when(F.size(hs) >= n, F.transform(F.sequence(F.lit(0), F.size(hs) - n), both))

    marks = items.where(F.col("n_words") >= span).withColumn("gs", _grams("hs", k)).select(F.explode(F.array_distinct(_least("gs", span - k + 1))).alias("fp"))
    spans = items.where(F.col("n_words") >= span).select("item", F.lit(span).alias("n"), F.explode(windows("hs", span)).alias("w"))
    for n in short:
        own = items.where(F.col("n_words") == n)
        marks = marks.unionByName(own.select(F.explode(_grams("hs", n, n)).alias("fp")))
        spans = spans.unionByName(own.select("item", F.lit(n).alias("n"), F.explode(windows("hs", n)).alias("w")))
    marks = written(marks.distinct(), "marks")
    spans = written(spans.select("item", "n", "w.*").distinct(), "spans")
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df

    # The one pass over all texts. The entries are a column of their own, so that the
    # arrays are not copied for each; an outer generator, or the optimizer filters on their size and makes them twice.
    text = F.col(text_col)
    bits = min(bitmap_bits, 1 << max(12, (64 * marks.count()).bit_length()))
    bitmap = written(_bitmap(marks, bits), "bitmap")
    rows = _fingerprinted(_hashed(docs, text, F.col(id_col).alias("id"), row_hash(text).alias("h")), span, k, short)
    rows = rows.select("id", "h", "n_words", "hs", F.inline_outer("entries")).join(F.broadcast(bitmap), F.lit(True))
    may = F.expr(f"shiftright(bits[cast(shiftright(fp & {bits - 1}L, 6) as int)], cast(fp & 63 as int)) & 1") == 1
    rows = rows.where((F.col("pos") < 0) | may)
    found = written(rows.select("id", "h", F.col("n_words").cast("long").alias("n_words"), "pos", "n", "fp", F.when(F.col("pos") >= 0, F.slice("hs", F.col("pos") + 1, F.col("windows") + F.col("n") - 1)).alias("hs")), "found")

    # Extension of the matches.
    near = found.where("pos >= 0").join(small(marks), "fp", "left_semi")
    there = None
    for n in [span, *short]:
        at = near.where(F.col("n") == n).select("id", "h", "n", "pos", F.posexplode(windows("hs", n)).alias("i", "w")).select("id", "h", "n", (F.col("pos") + F.col("i")).alias("pos"), "w.*")
        there = at if there is None else there.unionByName(at)
    plain = spans.select("n", "w1", "w2").distinct()
    hits = written(there.join(small(plain), ["n", "w1", "w2"]).distinct(), "hits")
    # Windows in order of their end, so that a short one inside a long one never sets the end back.
    ordered = F.array_sort(F.collect_set(F.struct((F.col("pos") + F.col("n")).alias("to"), "pos", "n")))
    covered = hits.groupBy("id", "h").agg(ordered.alias("at")).select("id", "h", _union(F.col("at")).cast("long").alias("n_hit"))
    named = hits.select("id", "h", "n", "w1", "w2").distinct().join(small(spans), ["n", "w1", "w2"]).where(F.col("item").isNotNull()).groupBy("id", "h").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    hit = covered.join(named, covered["id"].eqNullSafe(named["id"]) & (covered["h"] == named["h"]), "left").select(covered["id"].alias("__id"), covered["h"].alias("__h"), "n_hit", "items")
    hit = written(hit, "hit")
    out = found.where("pos < 0").select("id", "h", "n_words").join(hit, F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), "left")
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("id", "h", "n_words", n.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), (n > 0).alias("contaminated"))


def _union(at: Column) -> Column:
    """Words covered by windows given as (to, pos, n), in order of their end: counted from the last one back,
    each adds what lies before the start reached so far."""
    start = F.struct(F.lit(2**31 - 1).alias("edge"), F.lit(0).alias("sum"))
    step = lambda acc, x: F.struct(F.least(acc["edge"], x["pos"]).alias("edge"), (acc["sum"] + F.greatest(F.least(x["to"], acc["edge"]) - x["pos"], F.lit(0))).alias("sum"))
    return F.aggregate(F.reverse(at), start, step, lambda acc: acc["sum"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000, **params) -> DataFrame:
    """docs, all columns, without the rows that hold a benchmark window."""
    own_id, own_h = free(docs, "__id", "__h")
    found = contamination(docs, benchmark, id_col, text_col, broadcast_rows=broadcast_rows, **params)
    bad = written(found.where("contaminated").select(F.col("id").alias(own_id), F.col("h").alias(own_h)).distinct(), "bad")
    # Few rows are the rule: counted, and sent to the documents rather than these to them.
    bad = F.broadcast(bad) if bad.count() <= broadcast_rows else bad
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(own_id)) & (row_hash(F.col(text_col)) == F.col(own_h)), "left_anti")
