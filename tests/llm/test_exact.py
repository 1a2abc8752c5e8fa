"""Operators with one right result, against brute force in plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from harrow.llm import decontam, line_dedup, quality_rules, sharding, simhash, substring_dedup, tokens, warc
from harrow.llm.common import scratch, written

from .conftest import DOC, corpus

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def key(x):
    return (x[0] is not None, x)


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# --- substring dedup


def removed(rows, size=13):
    rank = lambda d: -1 if d is None else d
    least = {}
    texts = [SPACE.findall(t or "") for _, t, *_ in rows]
    for (d, *_), w in zip(rows, texts, strict=True):
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            least[g] = min(least.get(g, 1 << 60), rank(d))
    for (d, *_), w in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if least[tuple(w[i : i + size])] < rank(d):
                gone |= set(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        yield d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("params", [{}, {"bucket_windows": 40}, {"bucket_windows": 40, "hot": 1, "sample": 1.0}, {"bucket_windows": 40, "most_tasks": 2}])
def test_substring(docs, rows, params):
    got = [tuple(r) for r in substring_dedup.substring_dedup(docs, **params).collect()]
    same(got, removed(rows))


def test_substring_empty(empty):
    assert substring_dedup.substring_dedup(empty).count() == 0


# --- line dedup


def lines(rows, least_docs=3, least_chars=20):
    held = defaultdict(set)
    rank = lambda d: -1 if d is None else d
    keyed = []
    for d, t, *_ in rows:
        own = [(x, ascii_lower(x.strip(" \t\n\x0b\f\r"))) for x in (t or "").split("\n")]
        keyed.append((d, own))
        for _, k in own:
            if len(k) >= least_chars:
                held[k].add(rank(d))
    for d, own in keyed:
        kept = [x for x, k in own if len(k) < least_chars or len(held[k]) < least_docs or max(held[k]) == rank(d)]
        yield d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


@pytest.mark.parametrize("shard_keys", [1 << 20, 3])
def test_lines(docs, rows, shard_keys):
    same([tuple(r) for r in line_dedup.line_dedup(docs, shard_keys=shard_keys).collect()], lines(rows))


def test_lines_are_reversible(spark, docs, rows):
    more = spark.createDataFrame([(1000 + i, f"A common line that many documents hold, é.\nonly here, a line of its own {i % 2}", "en", "s", 1) for i in range(6)], DOC)
    index = line_dedup.LineIndex(spark, shards=3)
    index.insert(docs)
    before = {(r.k1, r.k2, r.n_docs, r.last) for r in index.counts.collect()}
    index.insert(more)
    both = rows + [tuple(r) for r in more.collect()]
    same([tuple(r) for r in index.apply(docs.select("doc_id", "text").unionByName(more.select("doc_id", "text"))).collect()], lines(both))
    index.delete(more)
    assert {(r.k1, r.k2, r.n_docs, r.last) for r in index.counts.collect()} == before
    same([tuple(r) for r in index.apply(docs).collect()], lines(rows))


def test_lines_empty(empty):
    assert line_dedup.line_dedup(empty).count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    k = rng.integers(-(2**63), 2**63 - 1, 5000, dtype=np.int64)
    chain = line_dedup.FilterChain()
    chain.insert(k[:100])
    chain.insert(k[100:])
    assert chain.contains(k).all()
    assert chain.contains(rng.integers(-(2**63), 2**63 - 1, 20000, dtype=np.int64)).mean() < 0.01
    chain.delete(k[:4000])
    assert chain.contains(k[4000:]).all()
    assert chain.contains(k[:4000]).mean() < 0.01


@pytest.mark.parametrize("seed", range(4))
def test_no_held_key_is_ever_lost(seed):
    """Lots of insertions and deletions over a chain several filters deep; fingerprints of few values collide often."""
    rng = np.random.default_rng(seed)
    chain, held = line_dedup.FilterChain(), np.empty(0, np.int64)
    for step in range(8):
        new = np.unique(rng.integers(0, 2**63 - 1, int(rng.integers(100, 30_000)), dtype=np.int64))
        if seed % 2:  # eight fingerprints only, many keys to a place
            new = np.unique(new % (1 << 14) + (rng.integers(1, 9, len(new)) << 48))
            new = new[rng.permutation(len(new))[:400]]
        new = new[~np.isin(new, held)]
        chain.insert(new)
        held = rng.permutation(np.concatenate([held, new]))
        cut = int(rng.integers(0, len(held)) * 0.6)
        chain.delete(held[:cut])
        held = held[cut:]
        assert chain.contains(held).all(), step
    assert len(chain.filters) >= 2
    chain.delete(held)
    assert not any(f.table.any() for f in chain.filters)


def test_filters_fill_up_whatever_the_shard():
    """The shard of a key says nothing about its place in the filter."""
    rng = np.random.default_rng(5)
    k1, k2 = rng.integers(-(2**63), 2**63 - 1, (2, 400_000), dtype=np.int64)
    for shards in (1, 16, 256):
        own = k2[k1 % shards == 0]
        chain = line_dedup.FilterChain()
        chain.insert(own)
        assert len(chain.filters) == 1 and (chain.filters[0].table > 0).mean() > 0.4


def test_lines_incrementally(spark, docs, rows):
    """Many changes, their counts merged from layers, against the table as a whole; the index opened anew each time."""
    index = line_dedup.LineIndex(spark, shards=2)
    index.insert(docs)
    rng, extra = random.Random(6), []
    for step in range(line_dedup.LAYERS + 2):
        index = line_dedup.LineIndex.open(spark, index.folder)
        if extra and rng.random() < 0.4:
            gone = [extra.pop(rng.randrange(len(extra)))]
            index.delete(spark.createDataFrame(gone, DOC))
        else:
            new = [(2000 + 10 * step + i, f"another common line {rng.randrange(3)} of some length\n{rng.choice(rows)[1] or ''}", "en", "s", 1) for i in range(3)]
            index.insert(spark.createDataFrame(new, DOC))
            extra += new
    assert len(index.layers) <= line_dedup.LAYERS
    # The tables that a change reads do not add up with the changes: postings of like size are one, filters are in one list.
    total = sum(n for _, n in index.posts)
    assert len(index.posts) <= 2 + np.log2(total) / 2 and all(a > 2 * b for (_, a), (_, b) in zip(index.posts, index.posts[1:], strict=False))
    assert index._filters()._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert index._postings(index.posts).groupBy("k1", "k2", "id").agg(F.sum("by").alias("by")).where("by < 0").count() == 0
    whole = spark.createDataFrame(rows + extra, DOC)
    same([tuple(r) for r in index.apply(whole).collect()], lines(rows + extra))


def test_string_ids(spark, rows):
    """Ids of any type that has an order."""
    named = [(None if d is None else f"d{d:05}", *r) for d, *r in rows]
    d = spark.createDataFrame(named, DOC.replace("doc_id bigint", "doc_id string"))
    name = lambda out: [(None if x[0] is None else f"d{x[0]:05}", *x[1:]) for x in out]
    same([tuple(r) for r in line_dedup.line_dedup(d).collect()], name(lines(rows)))
    same([tuple(r) for r in substring_dedup.substring_dedup(d).collect()], name(removed(rows)))


# --- simhash


def fingerprint(t, k=3):
    w = SPACE.findall(ascii_lower(t or ""))
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(fps, bits=2):
    parent = list(range(len(fps)))
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, rows):
    fps = [fingerprint(t) for _, t, *_ in rows]
    of = classes(fps)
    least = {}
    for (d, *_), c in zip(rows, of, strict=True):
        least[c] = min(x for x in (least.get(c), d) if x is not None) if d is not None or least.get(c) is not None else None
    got = [(r.id, r.fp % 2**64, r.component_id) for r in simhash.simhash_groups(docs).collect()]
    same(got, [(d, f, least[c]) for (d, *_), f, c in zip(rows, fps, of, strict=True)])


@pytest.mark.parametrize("limit", [64, 1, 4])
@pytest.mark.parametrize("bits", [2, 3])
def test_links(spark, limit, bits):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 6)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(25):
            v = int(b)
            for k in rng.integers(0, 63, rng.integers(1, 5)):
                v ^= 1 << int(k)
            fps.add(v)
    fps = sorted(fps)
    want = {(a, b) for i, b in enumerate(fps) for a in fps[:i] if (a ^ b).bit_count() <= bits}
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), bits, limit).collect()]
    assert set(got) == want and len(got) == len(want)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_near_dedup(docs, rows):
    of = classes([fingerprint(t) for _, t, *_ in rows])
    out = simhash.near_dedup(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(set(of))
    best = {}
    for (d, *_), c in zip(rows, of, strict=True):
        best[c] = min(best.get(c, 1 << 60), 1 << 59 if d is None else d)
    assert sorted(1 << 59 if r.doc_id is None else r.doc_id for r in got) == sorted(best.values())


def test_more_seeds_find_more_copies(spark):
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows = []
    for i in range(60):
        w = say(150)
        rows.append((2 * i, " ".join(w), "en", "s", 1))
        w[rng.randrange(150)] = "changed"
        rows.append((2 * i + 1, " ".join(w), "en", "s", 1))
    d = spark.createDataFrame(rows, DOC)
    one = {r.doc_id for r in simhash.near_dedup(d, max_bits=3).collect()}
    four = {r.doc_id for r in simhash.near_dedup(d, max_bits=3, seeds=(42, 43, 44, 45)).collect()}
    assert four < one and all(2 * i in four for i in range(60))
    assert sum(i % 2 for i in four) < 12


def test_simhash_empty(empty):
    assert simhash.simhash_groups(empty).count() == 0
    assert simhash.near_dedup(empty).count() == 0


# --- decontamination


def hits(rows, items, span=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    own = [(i, word.findall(ascii_lower(t or ""))) for i, t in items]
    windows = defaultdict(set)
    for i, w in own:
        n = min(span, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[j : j + n])].add(i)
    lengths = {len(g) for g in windows}
    for d, t, *_ in rows:
        w = word.findall(ascii_lower(t or ""))
        hit, found = set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if (g := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[g]
        names = sorted(str(i) for i in found if i is not None)
        yield d, len(w), len(hit), len(names), names, bool(hit)


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_decontamination(spark, docs, rows, broadcast_rows):
    texts = [t for _, t, *_ in rows if t and len(t.split()) > 15]
    items = [(i, " ".join(texts[i].split()[:14]).upper() if i % 2 else " , ".join(texts[i].split()[2:13])) for i in range(6)]
    items += [(10, None), (11, ""), (12, "x"), (13, "lang lang"), (14, texts[0].split()[0] + " " + texts[0].split()[1]), (15, items[0][1]), (None, items[1][1]), (2, items[2][1])]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = [(r.id, r.n_words, r.n_hit, r.n_items, list(r["items"]), r.contaminated) for r in decontam.contamination(docs, b, broadcast_rows=broadcast_rows).collect()]
    want = list(hits(rows, items))
    same(got, want)
    kept = decontam.decontaminate(docs, b)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)


def test_decontamination_empty(spark, docs, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.contamination(empty, none).count() == 0
    assert decontam.contamination(docs, none).where("contaminated").count() == 0


# --- quality rules


def base(t):
    t = t or ""
    w = SPACE.findall(t)
    ls = [x for x in t.split("\n") if SPACE.search(x)]
    n = defaultdict(list)
    for i in range(len(w) - 7):
        n[tuple(w[i : i + 8])].append(i)
    rep = {p for at in n.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)


def test_quality_counts(docs, rows):
    q = quality_rules.quality_rules(docs, min_docs=5)
    got = [(r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q.collect()]
    same(got, [(d, *base(t)) for d, t, *_ in rows])
    assert q.where("base_failed and kept").count() == 0


def test_quality_thresholds_adapt(spark):
    # Two sources, one of which uses symbols as a rule; a text with many stands out in the other only.
    plain, marked = "word text more of it here " * 5, "word# text# more# of# it# here# " * 5
    vary = lambda t, i: t + f"tail{i} and{i} so{i} on{i} with{i} it{i} all{i} the{i} way{i}"
    rows = [(i, vary(plain, i), "en", "a", 1) for i in range(200)] + [(i + 200, vary(marked, i), "en", "b", 1) for i in range(200)] + [(999, vary(marked, 5), "en", "a", 1)]
    rows = [(d, " ".join(f"{w}{d}{j}#" if w.endswith("#") else f"{w}{d}{j}" for j, w in enumerate(t.split())), x, s, n) for d, t, x, s, n in rows]
    kept = {r.id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, DOC)).collect()}
    assert all(kept[i] for i in range(400)) and not kept[999]


@pytest.mark.parametrize("rate", list(quality_rules.RATES))
def test_each_rate_gets_the_fence_of_its_source(spark, rate):
    """Two sources of different habits in one rate: their fences differ in it, and what is usual in one goes in the
    other."""
    rng = random.Random(7)

    def text(i, habit):
        words = [f"w{rng.randrange(10**6)}" + "x" * rng.randrange(3) for _ in range(rng.randrange(90, 130))]
        k = rng.randrange(20, 25) if habit else rng.choice([0, 0, 1])
        if rate == "symbols":
            words += ["#"] * k
        elif rate == "adjacent":
            words = [x for j, w in enumerate(words) for x in [w] * (2 if j < 2 * k else 1)]
        elif rate == "repeats":
            words = words + words[:8] * (1 if habit and rng.random() < 0.9 else 0) + words[8:16] * (1 if habit and rng.random() < 0.9 else 0)
        elif rate == "length":
            words = [w + "y" * (3 * k // 2 if habit else 0) for w in words]
        lines = [" ".join(words[j : j + 10]) for j in range(0, len(words), 10)]
        if rate == "dup_lines":
            lines += ["again"] * (k if habit else 0)
        return "\n".join(lines)

    rows = [(i, text(i, i % 2 == 1), "en", "ab"[i % 2], 1) for i in range(400)] + [(1000, text(0, True), "en", "a", 1)]
    st = written(quality_rules.counts(spark.createDataFrame(rows, DOC), F.col("text"), "doc_id", "lang", "source"), "stats")
    q = {r.source: r.q for r in quality_rules.with_quantiles(st, st.where("doc_id < 1000"), ("lang", "source"), 100).groupBy("source").agg(F.first("q").alias("q")).collect()}
    assert q["a"][rate].hi < q["b"][rate].hi and q["a"][rate].mid <= q["b"][rate].mid
    if rate != "repeats":  # its base rule leaves little room above a habit
        kept = {r.doc_id: r.kept for r in quality_rules.judge(st, ("lang", "source")).collect()}
        assert sum(kept[i] for i in range(400)) > 390 and not kept[1000]


def test_sketch_merges_and_bounds_error(spark):
    v = spark.range(1, 200_000).select(F.col("id").alias("v"))
    b = v.select("v", quality_rules.bucket("v").alias("b")).withColumn("least", quality_rules.bucket_least("b"))
    worst = b.select(F.max((F.col("v") - F.col("least")) / F.col("v"))).first()[0]
    assert 0 <= worst <= 1 / 32
    assert b.where("least > v").count() == 0


def test_quality_empty(empty):
    assert quality_rules.quality_rules(empty).count() == 0


# --- sharding


def shard(rows, limit):
    """Splits buckets one bit at a time."""
    rows = [(d, len((t or "").encode()), t) for d, t, *_ in rows]
    bits = lambda s: bin(int(hashlib.md5(s.encode()).hexdigest()[:15], 16))[2:].zfill(60)
    full = [(d, n, bits("" if d is None else str(d)) + bits((str(d) + "\0" if d is not None else "") + (t or ""))) for d, n, t in rows]
    out, todo = [], [("", full)]
    while todo:
        prefix, own = todo.pop()
        if not own:
            continue
        if sum(n for _, n, _ in own) <= limit or len(own) == 1 or len(prefix) == 120:
            out += [(d, n, prefix) for d, n, _ in own]
        else:
            todo += [(prefix + b, [x for x in own if x[2][len(prefix)] == b]) for b in "01"]
    return out


@pytest.mark.parametrize("limit", [1 << 20, 4000, 300, 20])
def test_sharding(docs, rows, limit):
    out = sharding.shards(docs, limit=limit).collect()
    same([(r.id, r.n_bytes, r.shard.split("#")[0]) for r in out], shard(rows, limit))
    total, n = defaultdict(int), defaultdict(int)
    for r in out:
        total[r.shard] += r.n_bytes
        n[r.shard] += 1
    assert all(total[s] <= limit or n[s] == 1 for s in total)


    rows_out = sharding.sharded(docs, limit=limit).collect()
    assert sorted((repr(r.doc_id), r.text or "", r.source or "", r.shard_) for r in rows_out) == sorted((repr(d), t or "", s or "", x) for (d, t, _, s, _), x in zip(sorted(rows, key=lambda r: (repr(r[0]), r[1] or "")), [r.shard_ for r in sorted(rows_out, key=lambda r: (repr(r.doc_id), r.text or ""))], strict=True))
    same([(r.doc_id, r.n_bytes_, r.shard_) for r in rows_out], [(r.id, r.n_bytes, r.shard) for r in out])


def test_sharding_empty(empty):
    assert sharding.shards(empty).count() == 0 and sharding.sharded(empty).count() == 0


# --- WARC


@pytest.mark.parametrize("least", [0, 5])
def test_warc(spark, least):
    data = [(1, "u1", "same payload"), (2, None, "same payload"), (3, "u3", None), (4, "u4", ""), (5, "u\r\n5", "é" * 3000), (6, "u6", "abc"), (7, "u7", "abc"), (1, "u8", "same payload"), (None, "u9", "same payload")]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string").withColumn("id", F.lit(1))
    folder = scratch(spark, "t")
    index = warc.write_bundles(pages, folder, revisit_least=least, frame_bytes=200, bundle_bytes=2000)
    got = warc.read_records(index, folder).collect()
    want = []
    for i, _, t in data:
        p = (t or "").encode()
        first = min(j for j, _, u in data if j is not None and (u or "") == (t or ""))
        twice = len(p) >= least and first != i
        want.append((i, len(p), warc.base32_sha1(p), "revisit" if twice else "response", first if twice else None))
    same([(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], want)
    # One record alone, and a whole bundle through a plain reader.
    five = warc.read_records(index.where("id = 5"), folder).first()
    assert bytes(five.payload).decode() == "é" * 3000
    import io

    import zstandard

    path = f"{folder}/{index.where('id = 5').first()['bundle']}".removeprefix("file://")
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(path, "rb").read()), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == index.where(F.col("bundle") == path.rpartition("/")[2]).count()


def test_warc_headers_and_odd_ids(spark):
    """Ids with line ends and brackets come back as they were; every record is dated."""
    data = [("a>\r\nWARC-Type: x", "u", "p"), ("b%41 é", "u", "p"), ("c", "u", "other")]
    pages = spark.createDataFrame(data, "page_id string, url string, html string")
    folder = scratch(spark, "t")
    index = warc.write_bundles(pages, folder, date="2024-05-06T07:08:09Z")
    got = sorted((r.id, r.record_type, r.refers_to) for r in warc.read_records(index, folder).collect())
    assert got == [(data[0][0], "response", None), (data[1][0], "revisit", data[0][0]), ("c", "response", None)]
    h, block = warc.parse(warc.record("c", "u", b"other", "D", None, "2024-05-06T07:08:09Z"))
    assert h["WARC-Date"] == "2024-05-06T07:08:09Z" and h["Content-Type"].startswith("text/html") and block == b"other"


def test_warc_read_is_dealt_by_bytes(spark):
    pages = spark.createDataFrame([(i, "u", f"{i} " * 4000) for i in range(200)], "page_id bigint, url string, html string")
    folder = scratch(spark, "t")
    index = warc.write_bundles(pages, folder, frame_bytes=20_000)
    read = warc.read_records(index, folder, part_bytes=500_000)
    assert read.count() == 200 and read.rdd.getNumPartitions() >= 6


def test_warc_empty(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# --- tokens


def test_tokens(spark, docs, rows):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = tokens.tokenize_round_trip(docs, path, 1).collect()
    whole = {(d, x): t.encode(x or "", add_special_tokens=False).ids + [1] for d, x, *_ in rows}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for d, x, *_ in order:
        ids = whole[d, x]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same([(r.id, r.start, r.n_tokens, r.ids_crc32) for r in out], want)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "it's 'x' don't", "É̀a ﬁ Σας İ", "x\x1cy\x85z\xa0w", "MAIL9@x.y_Z-É1 ªº ²³", "中文 words 12", "\t\r\n"])
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encode(text, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    assert tokens.encode([text], path, 7)[0].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [7]


@pytest.mark.parametrize("change", [None, ("normalizers", 1, "content", "a"), ("pretokenizers", 0, "behavior", "Isolated"), ("pretokenizers", 1, "add_prefix_space", True)])
def test_other_tokenizers_of_the_same_shape(tmp_path, change):
    """Words by themselves only under the very settings that allow it; always the library's ids."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    conf = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    if change:
        group, k, name, value = change
        conf["normalizer" if group == "normalizers" else "pre_tokenizer"][group][k][name] = value
    path = str(tmp_path / "t.json")
    json.dump(conf, open(path, "w"))
    assert tokens.Encoder(path).by_word == (change is None)
    for text in ["Some words,  and\nmore 12", "x" * 50 + " é à"]:
        assert tokens.encode([text], path, 7)[0].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [7]


def test_token_cache_is_bounded(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)) for _ in range(20)]
    e, t = tokens.Encoder(path), Tokenizer.from_file(path)
    for x in texts:
        assert np.frombuffer(e.text(x), np.uint32).tolist() == t.encode(x, add_special_tokens=False).ids
        assert e.known.size <= 10_000 and len(e.known) + len(e.known.older) < 500


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files(spark, docs, rows, tmp_path, encoding):
    import public_tokenizers
    import pyarrow.parquet as pq

    tokens.write_tokens(docs, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"), 1, encoding=encoding)
    files = [pq.ParquetFile(f) for f in (tmp_path / "t").glob("*.parquet")]
    cols = [f.metadata.row_group(0).column(f.metadata.num_columns - 1) for f in files if f.metadata.num_rows]
    assert all(any("DELTA" in e if encoding == "delta" else "DICTIONARY" in e for e in c.encodings) and c.has_offset_index for c in cols)
    plan = tokens.read_tokens(spark, str(tmp_path / "t"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "tokens:array" not in plan


def test_tokens_empty(empty):
    import public_tokenizers

    assert tokens.tokenize_round_trip(empty, public_tokenizers.path("word_bpe_49k.json"), 1).count() == 0


def test_corpus_has_the_cases():
    texts = [t for _, t, *_ in corpus()]
    assert None in texts and "" in texts and len(texts) > len(set(texts))
