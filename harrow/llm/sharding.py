"""Extendible hashing of documents into shards under a byte limit, in DataFrame operations only.

A document's id is hashed (the first 60 bits of its MD5), and a shard is a prefix of hash bits. All documents
start in the empty prefix; a bucket whose texts exceed ``limit`` bytes splits on the next bit, and only such
buckets do, so the shards are the shortest prefixes that fit. The directory is found without splitting step by
step: bytes are summed once per cell (a fine prefix, about 16 to a shard) and rolled up to every shorter
prefix; a cell's shard is its shortest prefix that fits. Cells that are themselves too large go on, alone, over
the remaining bits. Rows of one id that exceed the limit together (repeated or null ids) split further on the
bits of a hash of id and text, and equal rows, which no hash can split, go on numbered pages.

Every shard holds at most ``limit`` bytes, save one that holds a single longer document.

Defined results: null text has 0 bytes; a null id hashes as the empty string; repeated rows each get a row;
an empty table gives no rows. Extra columns are not read by ``shards``, and passed on by ``sharded``, whose own
columns give way to the table's (another underscore) where their names clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, written

BITS = 60


def _key(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def _settled(cells: DataFrame, first: int, last: int, limit: int) -> DataFrame:
    """cells (g, k of last - first bits, bytes, n) with depth: the shortest prefix of k, in bits beyond first,
    whose bucket fits; null where none does."""
    width = last - first
    at = cells.select("g", "k", "bytes", "n", F.explode(F.sequence(F.lit(0), F.lit(width))).alias("d")).withColumn("p", F.expr(f"shiftrightunsigned(k, {width} - d)"))
    fit = at.groupBy("g", "d", "p").agg(F.sum("bytes").alias("all_bytes"), F.sum("n").alias("all_n")).where((F.col("all_bytes") <= limit) | (F.col("all_n") == 1))
    least = at.select("g", "k", "d", "p").join(fit, ["g", "d", "p"]).groupBy("g", "k").agg((F.min("d") + first).alias("depth"))
    return cells.join(least, ["g", "k"], "left").select("g", "k", "depth")


def _bits(key: Column, depth: Column) -> Column:
    """The first depth of the key's bits, as 0 and 1."""
    return F.substring(F.lpad(F.bin(key), BITS, "0"), F.lit(1), depth)


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 16 << 20) -> DataFrame:
    """Per row of docs: id, n_bytes (long), depth (int, bits used), shard (string: the prefix; #n: its page)."""
    return _assigned(_base(docs, id_col, text_col, F.lit(None).cast("int")), limit).select("id", "n_bytes", "depth", "shard")


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 16 << 20) -> DataFrame:
    """docs, all columns, with n_bytes, depth and shard."""
    names = free(docs, "n_bytes", "depth", "shard")
    out = _assigned(_base(docs, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns])), limit)
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *[F.col(c).alias(n) for c, n in zip(("n_bytes", "depth", "shard"), names, strict=True)])


def _base(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    """row (what is passed on), id, n_bytes, k1 (bits of the id), k2 (bits of id and text, read by few rows only)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.col(id_col).cast("string")
    return docs.select(row.alias("row"), F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), _key(F.coalesce(name, F.lit(""))).alias("k1"), _key(F.concat_ws("\0", name, text)).alias("k2"))


def _assigned(base: DataFrame, limit: int) -> DataFrame:
    """base with depth and shard."""
    total = base.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    bits = min(BITS - 4, math.ceil(math.log2(max(1.0, total / limit))) + 4)
    rows = base.withColumn("cell", F.shiftrightunsigned("k1", BITS - bits))
    cells = rows.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")).select(F.lit(0).cast("long").alias("g"), F.col("cell").alias("k"), "bytes", "n")
    directory = written(_settled(written(cells, "cells"), 0, bits, limit).select(F.col("k").alias("cell"), "depth"), "directory")
    done = rows.join(directory, "cell").select("row", "id", "n_bytes", "k1", "depth")
    out = done.where("depth is not null").select("row", "id", "n_bytes", "depth", _bits(F.col("k1"), F.col("depth")).alias("shard"))
    over = directory.where("depth is null").select("cell")
    if over.isEmpty():
        return out

    # Cells that are too large, over the rest of the bits.
    rest = BITS - bits
    deep = rows.join(over, "cell", "left_semi")
    keys = deep.groupBy("cell", "k1").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")).select(F.col("cell").alias("g"), F.col("k1").bitwiseAND(F.lit((1 << rest) - 1).cast("long")).alias("k"), "bytes", "n")
    second = written(_settled(written(keys, "cells"), bits, BITS, limit).select((F.shiftleft("g", rest) + F.col("k")).alias("k1"), "depth"), "directory")
    out = out.unionByName(deep.join(second.where("depth is not null"), "k1").select("row", "id", "n_bytes", "depth", _bits(F.col("k1"), F.col("depth")).alias("shard")))
    over = second.where("depth is null").select("k1")
    if over.isEmpty():
        return out

    # Ids whose own rows are too large, over the bits of id and text.
    both = written(base.join(over, "k1", "left_semi").withColumn("place", F.monotonically_increasing_id()), "deep")
    keys = both.groupBy("k1", "k2").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")).select(F.col("k1").alias("g"), F.col("k2").alias("k"), "bytes", "n")
    third = written(_settled(written(keys, "cells"), BITS, 2 * BITS, limit).select(F.col("g").alias("k1"), F.col("k").alias("k2"), "depth"), "directory")
    name = F.concat(_bits(F.col("k1"), F.lit(BITS)), _bits(F.col("k2"), F.coalesce("depth", F.lit(2 * BITS)) - BITS))
    split = both.join(third.where("depth is not null"), ["k1", "k2"])
    out = out.unionByName(split.select("row", "id", "n_bytes", "depth", name.alias("shard")))
    equal = both.join(third.where("depth is null"), ["k1", "k2"])

    # Equal rows are numbered: those of each written part by themselves, from the sum of the parts before.
    part = F.shiftright("place", 33).alias("part")
    sums = equal.groupBy("k1", "k2", part).agg(F.count("*").alias("n"))
    before = sums.select("k1", "k2", "part", (F.sum("n").over(Window.partitionBy("k1", "k2").orderBy("part")) - F.col("n")).alias("before"))
    own = equal.withColumn("part", part).withColumn("nth", F.row_number().over(Window.partitionBy("k1", "k2", "part").orderBy("place")) - 1)
    own = own.join(before, ["k1", "k2", "part"]).withColumn("page", F.expr(f"(before + nth) div greatest({limit} div greatest(n_bytes, 1), 1)"))
    paged = F.concat(name, F.lit("#"), F.col("page").cast("string"))
    return out.unionByName(own.select("row", "id", "n_bytes", F.lit(2 * BITS).alias("depth"), paged.alias("shard")))
