"""Token ids in Parquet.

Texts are encoded with a ready tokenizer and written as rows of id, the token list and the text's metadata, in
ascending id order. The list column is delta-encoded (version-2 pages) or dictionary-encoded, row groups and
pages have set sizes, and the writer adds column and offset indexes, so that a reader takes the metadata
columns without the tokens, or a range of ids without the rest. All of it goes through Spark's own readers and
writers and works on any store they reach.

Order. Rows are in the order of their ids, and rows of one id in that of the table as Spark reads it. They are dealt
by ranges of id and position, so that a repeated or null id does not meet in one task. The part number and the offset
within the part are written with each row; the offset of a part is the sum of the parts before it, one small row each.

Encoding. A tokenizer that lower-cases, drops white space and takes every run of letters as one word gives a
text the ids of its runs of letters and of other signs, one after the other. With such a one each worker keeps
the ids of the runs it has met lately, at most ``CACHE_BYTES`` of them, whose older half goes when it is full, and
gives the library only new ones: runs of letters straight to its model, others to the whole of it. Texts beyond
Latin-1, with an apostrophe or with a special token's string, where runs are not independent, and all texts under
any other tokenizer, go to the library as they are.

Defined results: null text is empty; every text ends with the end id; rows of equal id follow each other in
the order they have in the table, null ids come first; an empty table writes an empty file. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, pieces, scratch

CACHE_BYTES = 80 << 20
#: What an entry takes besides its letters and ids: two objects' heads and its share of the table.
ENTRY_BYTES = 180
#: Runs of Latin-1 letters, and of anything else but blanks and line ends.
LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
RUNS = re.compile(f"[{LETTER}]+|[^{LETTER} \t\r\n]+")
#: The settings under which runs are independent. Any other tokenizer encodes whole texts.
BY_WORD = {
    "truncation": None,
    "padding": None,
    "post_processor": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_loaded: dict[str, Encoder] = {}


class Known(dict):
    """Ids by run; a run that is not there is looked up in the older ones or encoded, and counted."""

    __slots__ = ("older", "encode", "size")

    def __init__(self, older: dict[str, bytes], encode: Callable[[str], bytes]) -> None:
        self.older, self.encode, self.size = older, encode, 0

    def __missing__(self, run: str) -> bytes:
        ids = self.older.get(run) or self.encode(run)
        self[run] = ids
        self.size += len(run) + len(ids) + ENTRY_BYTES
        return ids


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = self.whole.get_added_tokens_decoder().values()
        self.special = [x.content for x in added]
        conf = json.loads(self.whole.to_str())
        model = conf.pop("model")
        self.by_word = {k: conf[k] for k in BY_WORD} == BY_WORD and model["type"] == "BPE" and not model["dropout"] and all(x.special and not (x.single_word or x.lstrip or x.rstrip or x.normalized) for x in added)
        self.known, self.tokenize = Known({}, self.run), self.whole.model.tokenize
        # The byte-level alphabet: printable Latin-1 stands for itself, the rest follows from 256 on.
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in own]
        self.alphabet = str.maketrans({b: chr(256 + k) for k, b in enumerate(others)})

    def of(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def run(self, run: str) -> bytes:
        if not run.isalpha():
            return self.of(run)
        shown = run if run.isascii() else run.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def text(self, text: str) -> bytes:
        if not self.by_word or not self.independent(text) or any(s in text for s in self.special):
            return self.of(text)
        runs, out = RUNS.findall(text.lower()), []
        for i in range(0, len(runs), 1 << 16):  # so that one very long text does not outgrow the bound
            out.append(b"".join(map(self.known.__getitem__, runs[i : i + (1 << 16)])))
            if self.known.size > CACHE_BYTES // 2:
                recent, self.known.older = self.known, {}
                self.known = Known(recent, self.run)
        return b"".join(out)

    @staticmethod
    def independent(text: str) -> bool:
        """Latin-1, where composition changes nothing and each letter has one lower-case letter, without an apostrophe."""
        if "'" in text:
            return False
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True


def encode(texts: list[str | None], path: str, end_id: int) -> list[np.ndarray]:
    """Token ids (uint32) of each text with the end id."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    e, end = _loaded[path], np.uint32(end_id).tobytes()
    return [np.frombuffer((e.text(t) if t else b"") + end, np.uint32) for t in texts]


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    meta_cols: tuple[str, ...] = ("lang", "source"),
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    part_bytes: int = 16 << 20,
) -> None:
    """Writes docs to path as (part, offset, id, n_tokens, meta, tokens)."""
    meta = [c for c in meta_cols if c in docs.columns]
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *[F.col(c).alias(f"meta_{c}") for c in meta], F.monotonically_increasing_id().alias("__m"))
    size = docs.agg(F.sum(F.octet_length(text).cast("long")).alias("n")).first()["n"] or 0  # of the texts, whatever packs them in files
    parts = max(1, min(-(-size // part_bytes), 1 << 18), min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // (1 << 20))))
    rows = rows.repartitionByRange(parts, "id", "__m").sortWithinPartitions("id", "__m").drop("__m").withColumn("part", F.spark_partition_id())
    kind = rows.schema["id"].dataType
    names = ["part", "offset", "id", "n_tokens", *[f"meta_{c}" for c in meta], "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset = 0
        for b in pieces(batches, 256):
            ids = encode(b.column(1).to_pylist(), tokenizer, end_id)
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.concatenate(ids).view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(b.num_columns - 1), pa.array(offset + ends - n), b.column(0), pa.array(n), *[b.column(2 + i) for i in range(len(meta))], lists], names)
            offset += int(ends[-1])

    schema = f"part int, offset bigint, id {kind.simpleString()}, n_tokens bigint, " + "".join(f"meta_{c} {docs.schema[c].dataType.simpleString()}, " for c in meta) + "tokens array<int>"
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": 2000, "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.writer.version": "v2" if encoding == "delta" else "v1", "compression": "zstd", "parquet.compression.codec.zstd.level": 1}
    arrow_map(rows, run, schema).write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("id", "n_tokens")) -> DataFrame:
    """start (ids of all rows before) and the columns asked for; only these are read from the files."""
    rows = spark.read.parquet(path)
    # One row a part, whose number is set by bytes: a running sum over these few rows.
    sizes = rows.groupBy("part").agg(F.max(F.col("offset") + F.col("n_tokens")).alias("size"))
    base = sizes.select(F.col("part").alias("__part"), (F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("__base"))
    return rows.join(F.broadcast(base), F.col("part") == F.col("__part")).select((F.col("__base") + F.col("offset")).alias("start"), *columns)


def token_crc32(rows: DataFrame) -> DataFrame:
    """rows with tokens replaced by ids_crc32: unsigned CRC-32 of the ids as little-endian 32-bit integers."""
    names = [c for c in rows.columns if c != "tokens"]
    at = rows.columns.index("tokens")
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names) + ", ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 256):
            lists = b.column(at)
            values, edges = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(memoryview(values[i:j])) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns) if i != at] + [pa.array(crc, pa.int64())], [*names, "ids_crc32"])

    return arrow_map(rows, run, schema)


def tokenize_round_trip(docs: DataFrame, tokenizer: str, end_id: int, **params) -> DataFrame:
    """id, start, n_tokens and ids_crc32 of every row, from the files written."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, **params)
    return token_crc32(read_tokens(docs.sparkSession, path, ("id", "n_tokens", "tokens")))
