"""Quality rules whose thresholds adapt to each language and source, in DataFrame operations only.

Per text a few counts are taken and turned into integer rates; the first odd symbol, repeated line or repeated window
of a text is not counted. Rates are held in mergeable quantile sketches, one per language, source and rate: counts of
log-linear buckets with 32 buckets to a power of two (relative error at most 1/32), whose merge is the sum of the
counts, so partial aggregation does most of the work and a hot source costs no more than a small one. Two rounds:

1. Typical documents. Of the documents that pass the base rules, those count as typical whose rates of kind SPREAD
   (which differ among all texts) lie within one and a half quartile distances of the group's quartiles.
2. Fences. The sketches of the typical documents give each rate's median and its 0.5 % and 99.5 % quantiles; a fence
   lies beyond the outer quantile by ``spread`` times its distance from the median. So a source whose texts use many
   symbols or repeat themselves gets a wide fence for that, one that never does gets a narrow one.

A group of fewer than ``min_docs`` documents takes the merged sketch of its language, and failing that of all.
Documents outside a fence, or that fail the base rules, are not kept. No threshold is fixed: quantile levels, spread
and min_docs are all there is.

Defined results: null and empty texts have no words and fail the base rules; null language and source are
groups of their own; each row is judged by itself, so repeated rows and ids give a row each; a rate whose
sketch is empty has no fence. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_RE, written

SYMBOLS = "[#*$%&|<>]"
#: Symbols, repeated and adjacent words per 1000 words, repeated lines per 1000 lines, code points per 100 words: the
#: count less what a single occurrence makes, the unit, and what it is taken of.
RATES = {"symbols": ("greatest(n_symbols - 1, 0)", 1000, "n_words"), "repeats": ("greatest(n_repeat_words - 16, 0)", 1000, "n_words"), "adjacent": ("n_adjacent", 1000, "n_words"), "dup_lines": ("greatest(n_dup_lines - 1, 0)", 1000, "n_lines"), "length": ("word_chars", 100, "n_words")}
#: Rates that differ among all texts, and so say which are typical; rates that can also be too low.
SPREAD = ("length", "adjacent")
LOW = ("length",)
#: Quantiles taken of a sketch, as fractions. A quantile is the least value of its bucket;
#: those that bound from above are the greatest value of their bucket, so that none in it lies outside.
LEVELS = {"lo": (1, 200), "q1": (1, 4), "mid": (1, 2), "q3": (3, 4), "hi": (199, 200)}
UPPER = ("q3", "hi")


def counts(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """keep and, per row, the counts of the text (long) and base_failed."""
    text = F.coalesce(text, F.lit(""))
    names = docs.select(*keep).columns
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*keep, F.array_remove(F.split(text, WHITE_RE), "").alias("words"), lines.alias("lines"), (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).alias("n_symbols"))
    df = df.select(
        *names,
        "n_symbols",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hs"),
    )
    gram = lambda i: F.xxhash64(*[F.get("hs", i + j) for j in range(8)])
    df = df.withColumn("gs", F.when(F.size("hs") >= 8, F.transform(F.sequence(F.lit(0), F.size("hs") - 8), gram)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("n_adjacent", F.size(F.filter("hs", lambda x, i: F.coalesce(F.get("hs", i - 1) == x, F.lit(False)))))
    # Most texts have no window twice; only the others sort theirs to find where.
    df = df.withColumn("twice", F.size("gs") > F.size(F.array_distinct("gs")))
    df = df.withColumn("at", F.when(F.col("twice"), F.sort_array(F.transform("gs", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get("at", j - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get("at", j + 1)["g"] == x["g"], F.lit(False))
    df = df.withColumn("at", F.sort_array(F.transform(F.filter("at", same), lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("to"), F.lit(0).alias("sum"))
    step = lambda acc, p: F.struct((p + 8).alias("to"), (acc["sum"] + p + 8 - F.greatest(p, acc["to"])).alias("sum"))
    df = df.withColumn("n_repeat_words", F.when(F.col("twice"), F.aggregate("at", start, step, lambda acc: acc["sum"])).otherwise(0))
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_adjacent", "n_lines"]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.select(*names, *[F.col(c).cast("long").alias(c) for c in longs], failed.alias("base_failed"))


def rates() -> dict[str, Column]:
    return {k: F.expr(f"{n} * {unit} div greatest({of}, 1)") for k, (n, unit, of) in RATES.items()}


def bucket(v: str) -> Column:
    """The sketch's bucket of a non-negative long."""
    return F.expr(f"case when {v} < 32 then {v} else 32 * (length(bin({v})) - 6) + shiftright({v}, length(bin({v})) - 6) end")


def bucket_least(b: str) -> Column:
    """The least value of a bucket; of the next one, less one, is its greatest."""
    return F.expr(f"case when {b} < 32 then {b} else shiftleft({b} - 32 * ({b} div 32 - 1), cast({b} div 32 - 1 as int)) end")


def sketch(stats: DataFrame, groups: list[str]) -> DataFrame:
    """The sketches of the rows: groups, rate, bucket, n. Merge: sum n."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), v.alias("v")) for k, v in rates().items()])).alias("r")
    return stats.select(*groups, each).select(*groups, "r.rate", bucket("r.v").alias("bucket")).groupBy(*groups, "rate", "bucket").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of coarser groups, by adding counts."""
    return sketches.groupBy(*groups, "rate", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """groups, total and q: a map from each rate to its quantiles."""
    up_to = Window.partitionBy(*groups, "rate").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    df = sketches.withColumn("to", F.sum("n").over(up_to)).withColumn("total", F.sum("n").over(Window.partitionBy(*groups, "rate")))
    at = [F.min(F.when(den * F.col("to") >= num * F.col("total"), F.col("bucket"))).alias(name) for name, (num, den) in LEVELS.items()]
    q = df.groupBy(*groups, "rate").agg(F.max("total").alias("total"), *at)
    q = q.select(*groups, "total", F.struct("rate", F.struct(*[(bucket_least(f"({name} + 1)") - 1 if name in UPPER else bucket_least(name)).alias(name) for name in LEVELS]).alias("q")).alias("e"))
    return q.groupBy(*groups).agg(F.max("total").alias("total"), F.map_from_entries(F.collect_list("e")).alias("q"))


def with_quantiles(stats: DataFrame, reference: DataFrame, group_cols: tuple[str, str], min_docs: int) -> DataFrame:
    """stats with q: the quantiles over reference for the row's language and source, or where these have fewer than
    min_docs rows there for its language, or else for all. As many rows as there are groups decide this."""
    lang, source = group_cols
    fine = written(sketch(reference, [lang, source]), "sketch")
    own = quantiles(fine, [lang, source]).where(F.col("total") >= min_docs).select(F.col(lang).alias("l1"), F.col(source).alias("s1"), F.col("q").alias("q_own"))
    by_lang = quantiles(merged(fine, [lang]), [lang]).where(F.col("total") >= min_docs).select(F.col(lang).alias("l2"), F.col("q").alias("q_lang"))
    of_all = quantiles(merged(fine.withColumn("__all", F.lit(0)), ["__all"]), ["__all"]).select(F.col("q").alias("q_all"))
    keys = stats.select(F.col(lang).alias("l"), F.col(source).alias("s")).distinct()
    limit = keys.join(own, F.col("l").eqNullSafe(F.col("l1")) & F.col("s").eqNullSafe(F.col("s1")), "left").join(by_lang, F.col("l").eqNullSafe(F.col("l2")), "left")
    # One row at most; it is null-padded when there is no reference.
    limit = limit.join(F.broadcast(of_all), F.lit(True), "left").select("l", "s", F.coalesce("q_own", "q_lang", "q_all").alias("q"))
    return stats.join(written(limit, "fences"), F.col(lang).eqNullSafe(F.col("l")) & F.col(source).eqNullSafe(F.col("s")), "left").drop("l", "s")


def typical() -> Column:
    """Within one and a half quartile distances of the quartiles, in the rates whose quartiles differ."""
    out = F.lit(True)
    for k in SPREAD:
        v, q1, q3 = rates()[k], F.col("q")[k]["q1"], F.col("q")[k]["q3"]
        out &= F.coalesce((q1 == q3) | ((2 * v >= 2 * q1 - 3 * (q3 - q1)) & (2 * v <= 2 * q3 + 3 * (q3 - q1))), F.lit(True))
    return out


def inside(spread: int) -> Column:
    """Within the fences of all rates."""
    out = F.lit(True)
    for k, v in rates().items():
        q = F.col("q")[k]
        out &= F.coalesce(v <= q["hi"] + spread * (q["hi"] - q["mid"]), F.lit(True))
        if k in LOW:
            out &= F.coalesce(v >= q["lo"] - spread * (q["mid"] - q["lo"]), F.lit(True))
    return out


def judge(stats: DataFrame, group_cols: tuple[str, str], min_docs: int = 100, spread: int = 3) -> DataFrame:
    """stats with kept."""
    fair = stats.where(~F.col("base_failed"))
    reference = with_quantiles(fair, fair, group_cols, min_docs).where(typical()).drop("q")
    return with_quantiles(stats, reference, group_cols, min_docs).withColumn("kept", ~F.col("base_failed") & inside(spread)).drop("q")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source"), min_docs: int = 100, spread: int = 3) -> DataFrame:
    """Per row of docs: id, lang, source, the counts, base_failed, kept."""
    keep = [F.col(id_col).alias("id"), F.col(group_cols[0]).alias("lang"), F.col(group_cols[1]).alias("source")]
    return judge(written(counts(docs, F.col(text_col), *keep), "stats"), ("lang", "source"), min_docs, spread)
