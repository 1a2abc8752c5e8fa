"""SimHash near-duplicate detection by multi-index hashing.

Each text is lower-cased (A-Z), cut into words and word shingles, and every shingle is hashed by XXH64. A bit
of the 64-bit fingerprint is one if it is set in over half the hashes. Fingerprints that differ in at most
``max_bits`` bits link, and the linked groups are the classes.

Candidate search. The fingerprint is cut into two 32-bit segments. If two fingerprints differ in at most three
bits, one of the segments differs in at most one, so it is enough to look up, segment by segment, the Hamming
ball of radius one around each segment value. Of two values one bit apart, one has the zero; enumerating only
the flips from zero to one finds every such pair once with half the probes. Whole distances are then verified.
Work is on distinct fingerprints, so a group of copies is one node. A segment value that very many distinct
fingerprints share would still make the pairs of its bucket grow with its square: such buckets (over
``bucket_limit``) are searched by a second index over the other segment's two 16-bit halves, and where those
are crowded as well by the full ball of radius ``max_bits`` over the last 16 bits, whose probes are exact
look-ups. No bucket is capped and no link is lost.

Components come from star contraction (large star, small star) over the links, each round written to the
shared folder; the rounds grow with the logarithm of the longest chain.

Tables that grow with the corpus are joined by sort and merge, as told by a hint: after an explode or a distinct Spark
takes a table for no larger than the compressed file beneath it, and would broadcast millions of rows by the driver.

Defined results: a null or wordless text has fingerprint zero, linked like any other; fewer words than a
shingle make one shingle of them all. Repeated rows each get a row out. Null ids get a row too; a component of
null ids only has a null component_id. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, free, pieces, row_hash, text_bytes, written


def fingerprint_one(text: bytes | None, shingle: int = 3, seeds: tuple[int, ...] = (42,)) -> list[int]:
    """The fingerprint under each seed, as signed 64-bit integers."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return [0] * len(seeds)
    line = b" ".join(words)
    if n <= shingle:
        grams = [line]
    else:
        at = np.zeros(n + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=at[1:])
        grams = [line[a:b] for a, b in zip(at[: n - shingle + 1].tolist(), (at[shingle:] - 1).tolist(), strict=True)]
    out = []
    for seed in seeds:
        total = np.zeros(64, np.int64)
        for i in range(0, len(grams), 65536):  # bounded however long the text
            h = np.array([xxh64_intdigest(g, seed) for g in grams[i : i + 65536]], dtype=">u8")
            total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * total > len(grams)).view(">i8")[0]))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """(id, h, fps array of long) of every row; h tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fps = pa.array([fingerprint_one(t, shingle, seeds) for t in text_bytes(b.column(2))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps], ["id", "h", "fps"])

    rows = docs.select(F.col(id_col).alias("id"), row_hash(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, h bigint, fps array<bigint>")


def _ball(value, bits: int):
    """value and it with one zero bit set: half of the ball of radius one."""
    flips = F.array(*[F.when(F.shiftright(value, k).bitwiseAND(1) == 0, value.bitwiseOR(F.lit(1 << k).cast("long"))) for k in range(bits)])
    return F.array_compact(F.concat(F.array(value), flips))


def _full_ball(value, bits: int, radius: int):
    """All values within radius bits of value."""
    masks = [0]
    for _ in range(radius):
        masks = sorted({m ^ (1 << k) for m in masks for k in range(bits)} | set(masks))
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))


def _segment(fp, k: int, bits: int):
    """Segment k of the given width, from the low end, as a non-negative long."""
    return F.shiftrightunsigned(fp, k * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _verified(probe: DataFrame, table: DataFrame, keys: list[str], max_bits: int) -> DataFrame:
    found = probe.withColumnRenamed("fp", "a").join(table.withColumnRenamed("fp", "b").hint("merge"), keys)
    return found.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")


def links(fps: DataFrame, max_bits: int = 2, bucket_limit: int = 64) -> DataFrame:
    """(a, b) with a < b: pairs of distinct fingerprints at most max_bits apart. fps: distinct fp long."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments and balls of radius one find distances up to 3")
    fp = F.col("fp")
    table = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("seg"), _segment(fp, k, 32).alias("value")) for k in (0, 1)])).alias("s")).select("fp", "s.*")
    crowded = written(table.groupBy("seg", "value").count().where(F.col("count") > bucket_limit).select("seg", "value"), "crowded")
    probe = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("seg"), _ball(_segment(fp, k, 32), 32).alias("ball")) for k in (0, 1)])).alias("s")).select("fp", "s.seg", F.explode("s.ball").alias("value"))
    if crowded.isEmpty():
        pairs = _verified(probe, table, ["seg", "value"], max_bits)
    else:
        plain = _verified(probe.join(crowded, ["seg", "value"], "left_anti"), table, ["seg", "value"], max_bits)
        # Second index, of the crowded buckets only, over the 16-bit halves of the other segment.
        low = F.lit(0xFFFF).cast("long")
        halves = lambda f: F.explode(F.array(F.struct(F.lit(0).alias("half"), f(F.col("other").bitwiseAND(low)).alias("part"), F.shiftright("other", 16).alias("last")), F.struct(F.lit(1).alias("half"), f(F.shiftright("other", 16)).alias("part"), F.col("other").bitwiseAND(low).alias("last")))).alias("h")
        deep = lambda df: df.join(crowded, ["seg", "value"], "left_semi").withColumn("other", F.when(F.col("seg") == 0, _segment(fp, 1, 32)).otherwise(_segment(fp, 0, 32)))
        sub = ["seg", "value", "half", "part"]
        table2 = deep(table).select("fp", "seg", "value", halves(lambda c: c)).select("fp", "seg", "value", "h.*")
        crowded2 = written(table2.groupBy(*sub).count().where(F.col("count") > bucket_limit).select(*sub), "crowded")
        # The whole ball here, not half of it: the first segment's flip has already set the direction.
        probe2 = deep(probe).select("fp", "seg", "value", halves(lambda c: _full_ball(c, 16, 1))).select("fp", "seg", "value", "h.half", "h.last", F.explode("h.part").alias("part"))
        second = _verified(probe2.join(crowded2, sub, "left_anti"), table2, sub, max_bits)
        # Third: 48 bits are shared up to the flips, the last 16 are looked up whole.
        third = _verified(probe2.join(crowded2, sub, "left_semi").withColumn("last", F.explode(_full_ball(F.col("last"), 16, max_bits))), table2.join(crowded2, sub, "left_semi"), [*sub, "last"], max_bits)
        pairs = plain.unionByName(second).unionByName(third)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of each node's component, for the nodes of the edges. Large star and small
    star in turn (Kiveris et al. 2014) until nothing moves; each round is a written table."""
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = written(small, "edges")
        # The edges stop changing when each node has one edge, to its root; the sum tells a changed set.
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == now:
            break
        seen = now
    rooted = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.unionByName(rooted.select(F.col("root").alias("node"), "root")).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, seed: int = 42) -> DataFrame:
    """Per row: id, h, fp (long), component_id (least id of the linked group), component (its least fingerprint)."""
    fps = written(fingerprints(docs, id_col, text_col, shingle, (seed,)).select("id", "h", F.get("fps", F.lit(0)).alias("fp")), "fps")
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    comp = components(links(nodes.select("fp"), max_bits)).select(F.col("node").alias("fp"), F.col("root").alias("component"))
    rooted = nodes.join(comp.hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = rooted.groupBy("component").agg(F.min("id").alias("component_id"))
    of = written(rooted.select("fp", "component").join(named.hint("merge"), "component").select("fp", "component", "component_id"), "components")
    return fps.join(of.hint("merge"), "fp").select("id", "h", "fp", "component", "component_id")


def _node(fps: Column) -> Column:
    """Stands for an array of fingerprints: 120 hash bits as a decimal, so that two arrays do not meet by chance."""
    half = lambda *seed: F.shiftrightunsigned(F.xxhash64(*seed, fps), 4).cast("decimal(20,0)")
    return (half() * F.lit(1 << 60).cast("decimal(19,0)") + half(F.lit(1))).cast("decimal(38,0)")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """docs, all columns, with one row of each linked group: that of the least id (null ids last), of rows of
    that id the one with the least text hash, of equal rows any one. With more seeds there is a fingerprint and
    an index for each, and texts link that are near under any of them: near copies whose distance under one
    seed happens to be large are found by another."""
    prints = written(fingerprints(docs, id_col, text_col, shingle, seeds).withColumn("node", _node(F.col("fps"))), "fps")
    nodes = written(prints.select("node", "fps").distinct(), "nodes")
    edges = []
    for k in range(len(seeds)):
        own = nodes.select("node", F.get("fps", F.lit(k)).alias("fp"))
        # Each fingerprint is stood for by one of its texts, to which the others of that fingerprint link.
        first = written(own.groupBy("fp").agg(F.min("node").alias("rep")), "reps")
        a, b = first.select(F.col("fp").alias("a"), F.col("rep").alias("u")), first.select(F.col("fp").alias("b"), F.col("rep").alias("v"))
        near = links(first.select("fp"), max_bits).join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("u", "v")
        # Written seed by seed: one plan over all seeds would be as large as all of them for the driver.
        edges.append(written(near.unionByName(own.join(first.hint("merge"), "fp").where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))), "edges"))
    union = edges[0]
    for e in edges[1:]:
        union = union.unionByName(e)
    comp = components(union, "u", "v")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    g = prints.select("id", "h", "node").join(comp.hint("merge"), "node", "left").withColumn("group", F.coalesce("root", "node"))
    own_id, own_h, own_k = free(docs, "__id", "__h", "__k")
    first = written(g.groupBy("group").agg(F.min(order).alias("first")).select(F.col("first.id").alias(own_id), F.col("first.h").alias(own_h)), "first")
    on = F.col(id_col).eqNullSafe(F.col(own_id)) & (row_hash(F.col(text_col)) == F.col(own_h))
    # As large as docs in rows: never broadcast.
    kept = docs.join(first.hint("merge"), on, "left_semi")
    # Equal rows pass the join together; they meet in a further shuffle only where there are any.
    again = prints.groupBy("id", "h").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        return kept
    return kept.withColumn(own_k, row_hash(F.col(text_col))).dropDuplicates([id_col, own_k]).drop(own_k)
