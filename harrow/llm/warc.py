"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with a group of whole WARC records of about
``frame_bytes`` bytes, and ends in the seek table of the Zstandard seekable format: a skippable frame with the
compressed and the plain size of every frame. Any Zstandard reader reads the whole of it; this one finds frame
k by the sums of the sizes before it and unpacks that frame alone. An index table maps each record's id to its
bundle, frame, and offset and length within the plain frame.

Records. One WARC/1.1 record per page. Of records whose payloads are equal and at least ``revisit_least`` bytes
long, that of the least id is a response and the others are revisits that refer to it and carry no payload.
Tasks write their bundles frame by frame under names of their own and rename them, and the index names only renamed
files, so retried tasks do no harm. A worker holds one frame. Reading deals the frames out by their bytes.

A record says when it was made (``date``, the time of the call unless given) and bears its page's id, percent-encoded,
so that ids of any signs come back as they were.

Defined results: null payloads are empty; rows that share the least id of a payload are all responses; rows
with a null id come after all others, and among them alone all are responses. Null addresses are empty.
Extra columns are not read; an empty table gives no bundle and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedFile, arrow_map, open_read, pieces, scratch, text_bytes, written

SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
INDEX = "bundle string, frame int, offset int, length int, id {id}"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(key: str) -> str:
    return f"<urn:page:{quote(key, safe='')}>"


def key_of(name: str) -> str:
    return unquote(name.removeprefix("<urn:page:")[:-1])


def record(key: str, url: str, payload: bytes, digest: str, refers_to: str | None, date: str, content_type: str = "text/html; charset=utf-8") -> bytes:
    """One WARC record; key and refers_to are page ids as text."""
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(key)}", f"WARC-Date: {date}", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += [f"Content-Type: {content_type}", f"Content-Length: {len(payload)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record at the start of data."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer: sizes are (compressed, plain) by frame."""
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(start, compressed, plain) of each frame of an open bundle."""
    f.seek(0, 2)
    end = f.tell()
    f.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE or flags & 0x7C:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    f.seek(end - 9 - entry * n)
    data = f.read(entry * n)
    out, at = [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", data, k * entry)
        out.append((at, packed, plain))
        at += packed
    return out


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, revisit_least: int) -> DataFrame:
    """id, url, payload, refers_to: the id of the response that a row revisits, or null."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    # The digest alone is dealt out first; only digests seen twice come back, and the payloads follow them.
    sums = rows.select("id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")).where(F.col("n") >= revisit_least)
    twice = sums.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("times")).where("times > 1 and first is not null")
    twice = written(twice.select(F.col("digest").alias("__digest"), "first"), "digests")
    joined = rows.join(twice, F.sha1("payload") == F.col("__digest"), "left")
    return joined.select("id", "url", "payload", F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_least: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3, date: str | None = None) -> DataFrame:
    """Writes the bundles and the index under folder; returns the index as read back."""
    rows = with_revisits(pages, id_col, url_col, payload_col, revisit_least)
    when = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        file, name, kind = None, "", None
        frame, index = [], []
        sizes: list[tuple[int, int]] = []
        held = 0

        def close_frame() -> None:
            nonlocal held
            if frame:
                packed = pack.compress(b"".join(frame))
                file.write(packed)
                sizes.append((len(packed), held))
                frame.clear()
                held = 0

        def close_bundle() -> pa.RecordBatch:
            nonlocal file
            close_frame()
            file.write(seek_table(sizes))
            file.commit()
            out = pa.RecordBatch.from_arrays([pa.array([name] * len(index), pa.string()), *[pa.array([x[i] for x in index], pa.int32()) for i in range(3)], pa.array([x[3] for x in index], kind)], ["bundle", "frame", "offset", "length", "id"])
            index.clear()
            sizes.clear()
            file = None
            return out

        for b in pieces(batches, 64):
            kind = b.column(0).type
            for key, url, payload, first in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if file is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    file = SharedFile(f"{folder}/{name}")
                r = record("" if key is None else str(key), (url or b"").decode(), payload, base32_sha1(payload), None if first is None else str(first), when)
                index.append((len(sizes), held, len(r), key))
                frame.append(r)
                held += len(r)
                if held >= frame_bytes:
                    close_frame()
                    if sum(x for x, _ in sizes) >= bundle_bytes:
                        yield close_bundle()
        if file is not None:
            yield close_bundle()

    kind_name = rows.schema["id"].dataType.simpleString()
    arrow_map(rows, run, INDEX.format(id=kind_name)).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, with_payload: bool = True, part_bytes: int = 16 << 20) -> DataFrame:
    """The records an index (or any part of it) names: id, target, payload_bytes, payload_digest, record_type,
    refers_to, and payload if asked. Only the frames that hold them are read, some part_bytes of records a task;
    digests of responses are checked."""
    kind = index.schema["id"].dataType.simpleString()
    # Index rows are few bytes for much to read: the number of tasks is set by what they stand for.
    size = index.agg(F.sum(F.col("length").cast("long")).alias("n")).first()["n"] or 0
    dealt = index.repartition(max(1, min(-(-size // part_bytes), 1 << 17)), "bundle", "frame")
    at = dealt.groupBy("bundle", "frame").agg(F.collect_list(F.struct("offset", "length", "id")).alias("records")).sortWithinPartitions("bundle", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        open_name, f, table = "", None, []
        for b in batches:
            id_type = b.schema.field("records").type.value_type.field("id").type
            for name, frame, records in zip(*[b.column(c).to_pylist() for c in ("bundle", "frame", "records")], strict=True):
                if name != open_name:
                    if f is not None:
                        f.close()
                    open_name, f = name, open_read(f"{folder}/{name}")
                    table = read_seek_table(f)
                start, packed, plain = table[frame]
                f.seek(start)
                data = unpack.decompress(f.read(packed), max_output_size=plain)
                rows = []
                for r in records:
                    h, block = parse(data[r["offset"] : r["offset"] + r["length"]])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and base32_sha1(block) != digest:
                        raise ValueError(f"digest of {h['WARC-Record-ID']} in {name} does not match")
                    refers = key_of(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
                    rows.append((r["id"], h["WARC-Target-URI"], int(h["X-Payload-Length"]), digest, h["WARC-Type"], refers, block if with_payload and refers is None else None))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate([id_type, pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()])], ["id", "target", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if f is not None:
            f.close()

    out = arrow_map(at, run, f"id {kind}, target string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary")
    out = out.withColumn("refers_to", F.col("refers_to").cast(kind))
    return out if with_payload else out.drop("payload")


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", **params) -> DataFrame:
    """All records, without their payloads, as read back and checked from the bundles written."""
    folder = scratch(pages.sparkSession, "warc")
    return read_records(write_bundles(pages, folder, id_col, url_col, payload_col, **params), folder, with_payload=False)
