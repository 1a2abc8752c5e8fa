"""What a page offers to an extractor: repeated anchors, embedded state, and what a selector finds on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import html as D

#: Attributes that may mark repeated units, in order, and the limits of the report.
ANCHORS = ["data-testid", "itemprop", "data-cy", "data-qa", "aria-label", "role"]
MOST_ANCHORS, ANCHOR_SAMPLE, MOST_EMBEDDED, STATE_CHARS, PREVIEW, SAMPLES, SAMPLE_TEXT, SAMPLE_HTML = 30, 80, 5, 40, 400, 5, 200, 400


def anchors(pages: DataFrame, page: str, html: str) -> DataFrame:
    """page, rank, selector, n, sample: attribute values, without a number at their end, that come twice or more on a
    page; the most frequent first, then in the order of ANCHORS and of the page. sample: the text of the first element."""
    e = D.with_elements(pages.select(page, html), html).select(page, "elements_text", F.explode("elements").alias("e"))
    marked = e.where(F.arrays_overlap(F.map_keys("e.attrs"), F.array(*map(F.lit, ANCHORS))))
    each = marked.select(page, F.col("e.pos").alias("pos"), F.posexplode(F.transform(F.array(*map(F.lit, ANCHORS)), lambda k: F.struct(k.alias("k"), F.element_at("e.attrs", k).alias("v")))).alias("at", "a"), X.truncate_ws(D.text(F.col("e")), ANCHOR_SAMPLE).alias("sample")).where("a.v is not null")
    units = each.groupBy(page, "at", F.col("a.k").alias("attribute"), X.anchor_stem(F.col("a.v")).alias("stem")).agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.min_by("sample", "pos").alias("sample")).where("n >= 2")
    order = Window.partitionBy(page).orderBy(F.desc("n"), "at", "first")
    how = F.when(X.anchor_stem(F.col("stem")) == F.col("stem"), "^=").otherwise("=")
    ranked = units.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MOST_ANCHORS)
    return ranked.select(page, "rank", F.concat(F.lit("["), "attribute", how, F.lit('"'), "stem", F.lit('"]')).alias("selector"), "n", "sample")


def embedded(pages: DataFrame, page: str, html: str) -> DataFrame:
    """page, rank, source, chars, preview: scripts that hold the page's state, the first MOST_EMBEDDED of a page."""
    p = D.with_elements(pages.select(page, html), html)
    attr = lambda e, k: F.coalesce(F.element_at(e["attrs"], k), F.lit(""))
    kind = lambda e: (
        F.when(attr(e, "id") == "__NEXT_DATA__", "__NEXT_DATA__")
        .when(F.contains(attr(e, "type"), F.lit("ld+json")), "application/ld+json")
        .when((e["end"] - e["start"] >= STATE_CHARS) & D.text(e).rlike(r"^\s*(window\.__|self\.__)"), "inline state")
    )
    found = F.filter(F.transform(D.select(F.col("elements"), "script"), lambda e: F.struct(kind(e).alias("source"), (e["end"] - e["start"]).alias("chars"), D.text(e).alias("text"))), lambda s: s["source"].isNotNull())
    return p.select(page, F.posexplode(F.slice(found, 1, MOST_EMBEDDED)).alias("k", "s")).select(page, (F.col("k") + 1).alias("rank"), "s.source", "s.chars", X.truncate_ws(F.col("s.text"), PREVIEW).alias("preview"))


def _squeezed(text: Column, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def queried(pages: DataFrame, page: str, html: str, selectors: list[str], whole_refs: bool = False) -> DataFrame:
    """page, selector, n, samples (text and html of the first SAMPLES elements), for every page and selector."""
    p = D.with_elements(pages.select(page, html), html, whole_refs=whole_refs)
    sample = lambda e: F.struct(_squeezed(D.text(e), SAMPLE_TEXT).alias("text"), F.substring(D.source(e, html), 1, SAMPLE_HTML).alias("html"))
    found = lambda s: F.transform(F.array(D.select(F.col("elements"), s)), lambda x: F.struct(F.lit(s).alias("selector"), F.size(x).cast("long").alias("n"), F.transform(F.slice(x, 1, SAMPLES), sample).alias("samples")))
    return p.select(page, F.explode(F.concat(*map(found, selectors))).alias("q")).select(page, "q.selector", "q.n", "q.samples")
