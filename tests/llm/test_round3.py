"""Phrases, the prefix trie and languages, against brute force in plain Python and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm import langid, phrases, prefix_trie

from .conftest import DOC
from .test_exact import ascii_lower, same

# --- phrases


def best_phrases(rows, least=10, share=50, top=2000):
    f, n = Counter(), Counter()
    for _, t, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = defaultdict(int)
    for (lang, p), a in cands.items():
        if len(p) == 3:
            for q in (p[:2], p[1:]):
                longer[lang, q] = max(longer[lang, q], a)
    out = defaultdict(list)
    for (lang, p), a in cands.items():
        if 100 * longer[lang, p] >= share * a:
            continue
        score, _, x, y = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), x, y))
    for lang, found in out.items():
        for rank, (score, a, p, x, y) in enumerate(sorted(found)[:top], 1):
            yield lang, rank, p.decode(), -a, x, y, n[lang], -score


@pytest.mark.parametrize("params", [{}, {"top": 7}, {"most_bits": 12}, {"least": 3, "share": 80}])
def test_phrases(docs, rows, params):
    got = [tuple(r) for r in phrases.collocations(docs, **params).collect()]
    want = list(best_phrases(rows, **{k: v for k, v in params.items() if k != "most_bits"}))
    assert len(want) > 10
    same(got, want)


@pytest.mark.parametrize("size", [1, 30, 400])
def test_phrases_over_shards(size):
    """Sequences that go over the end of a shard are counted once."""
    rng = random.Random(size)
    texts = [" ".join(rng.choice("abc,d") for _ in range(rng.randint(0, 300))).replace("b", "b.").encode() for _ in range(12)] + [b"", b" ", b"\t a\x0b", b"a a a a " * 100]
    got, single = Counter(), Counter()
    for s in phrases.shards("x", texts, 3, size):
        names = []
        for n, at, _ in s.sequences():
            names += s.phrases(n, at) if n > 1 else []
        got.update({k.encode(): int(v) for k, v in zip(names, s.counted(names), strict=True) if v})
        single.update(s.words[i].encode() for i in s.ids[s.repeated :].tolist() if i != phrases.BREAK)
    want, alone = Counter(), Counter()
    for t in texts:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(rb"[^\x20\x09]+", piece)
            alone.update(w)
            for m in (2, 3):
                want.update(b" ".join(w[i : i + m]) for i in range(len(w) - m + 1))
    assert got == want and single == alone


def test_sketch_counters():
    """Counters saturate, and count like a plain table below that."""
    rng = np.random.default_rng(0)
    total, counters = Counter(), np.zeros(3000, np.int64)
    for _ in range(4):
        bins = np.sort(np.concatenate([rng.integers(0, 3000, 500), rng.integers(0, 5, 60), [2999]]))
        total.update(bins.tolist())
        phrases.added(counters, phrases.steps(bins, 10), 10)
    assert [min(total[i], 10) for i in range(3000)] == counters.tolist()


def test_phrase_scores_are_exact(spark):
    """Products beyond 64 bits."""
    big = 10**12 + 7
    rows = [("x", 1, "a", big + 5), ("x", 1, "b", big), ("x", 2, "a b", big - 3), ("x", 0, "", 2 * big)]
    counts = spark.createDataFrame(rows, "lang string, words int, phrase string, f bigint")
    (r,) = phrases.scored(counts).collect()
    assert r.score == 10**6 * (big - 3) ** 2 // ((big + 5) * big) and (r.l, r.r) == (big + 5, big)


def test_phrases_empty(empty):
    assert phrases.collocations(empty).count() == 0


# --- conversations

CONV = "conv_id bigint, turn bigint, role string, text string, key string, block int, n int"


def conversations(seed, n=240, depth=7):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-30, 400), n):
        for t in range(rng.randint(1, depth)):
            out.append((c, rng.choice([t, t, t, None]) if rng.random() < 0.1 else t, rng.choice(["user", "user", None]), rng.choice(["é", "bb", "ccc", None, ""]) if t < 3 else rng.choice("xyz"), "k", 1, 1))
    out += [(None, 0, "user", "lost", "k", 1, 1), (7, 3, "user", "tie", "k", 1, 1), (7, 3, "user", "tie", "k", 1, 1), (7, 3, None, "other", "k", 1, 1)]
    out += [(c, t, "user", f"same {t}", "k", 1, 1) for c in range(1000, 1060) for t in range(4)]
    return out


def trie(rows):
    digest = lambda r, t: hashlib.md5(f"{len((r or '').encode())}:{r or ''}{t or ''}".encode()).hexdigest()
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, digest(role, text), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        full[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    for node, m in members.items():
        subtree = below[node]
        kids = sum(len(x) == len(node) + 1 for x in subtree)
        leaves = sum(len(below[x]) == 1 for x in subtree)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in subtree if x)
        ends = ",".join(map(str, sorted(c for c in m if len(full[c]) == len(node))))
        yield min(m), len(node), min(members[node[:-1]]) if node else None, len(m), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()


def built(turns):
    c = F.col("conv_id")
    return prefix_trie.prefix_trie(prefix_trie.spliced(prefix_trie.sequences(turns), c - c % 100, F.crc32(c.cast("string")) % 6, most=5))


@pytest.mark.parametrize("seed, blocks, limit", [(1, 1, 4096), (2, 3, 4096), (3, 17, 2), (4, 60, 1), (5, 200, 3)])
def test_trie(spark, monkeypatch, seed, blocks, limit):
    """Blocks of any size, with runs and lists of children that do not fit into memory's bounds."""
    rows = conversations(seed)
    monkeypatch.setattr(prefix_trie, "PENDING", limit)
    monkeypatch.setattr(prefix_trie, "RUN", limit)
    seqs = prefix_trie.spliced(prefix_trie.sequences(spark.createDataFrame(rows, CONV)), F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string")) % 6, most=5)
    keys = sorted((("".join(t.digest for t in r.turns)), r.conv_id, [t.chars for t in r.turns]) for r in seqs.collect())
    found, opened, size = [], [], -(-len(keys) // blocks)
    for b in range(blocks):
        if part := keys[b * size : (b + 1) * size]:
            state = prefix_trie.Block(b)
            for key, conv, chars in part:
                state.add(conv, key, chars)
            state.end()
            found += state.rows
    opened = sorted([r[1], r[2], r[11], r[12]] for r in found if r[0] == prefix_trie.OPEN)
    top = prefix_trie.Top()
    for r in sorted(opened, key=lambda x: (x[0], x[2])):
        top.add(*r)
    top.down_to(-1)
    found += top.rows
    up = {(r[1], r[2]): r[3] for r in found if r[0] == prefix_trie.PARENT}
    nodes = [(*r[3:5], up[r[1], r[2]] if r[0] == prefix_trie.CHILD else r[5], *r[6:11]) for r in found if r[0] in (prefix_trie.NODE, prefix_trie.CHILD)]
    same(nodes, trie(rows))


def test_trie_in_spark(spark):
    rows = conversations(9)
    same([tuple(r) for r in built(spark.createDataFrame(rows, CONV)).collect()], trie(rows))


def test_trie_of_turnless(spark):
    """A conversation whose turns all fall to an absent donor is a member of the root alone."""
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 2)
    rows = [(c, 0, "user", "a", "k", 1, 1), (c, 1, "user", "b", "k", 1, 1)]
    got = [tuple(r) for r in built(spark.createDataFrame(rows, CONV)).collect()]
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    same(got, trie(rows))


def test_trie_empty(spark):
    assert built(spark.createDataFrame([], CONV)).count() == 0


# --- languages


def invented(seed=0, n=240):
    """Texts in three invented languages, some of two, with what has no language."""
    rng = random.Random(seed)
    parts = {"aa": ["the", "ing", "and", "ion", "er", "th"], "bb": ["sch", "ung", "der", "ein", "ü", "ch"], "cc": ["qué", "ció", "ñ", "as", "os", "la"]}
    say = lambda k, n: " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = []
    for i in range(n):
        k = rng.choice(list(parts))
        rows.append((i, say(k, rng.randint(5, 80)), k, "s", 0))
    rows += [(n, None, "aa", "s", 0), (n + 1, "", "aa", "s", 0), (n + 2, "12 ### \n", "bb", "s", 0), (n + 3, say("aa", 300) + ". " + say("cc", 150), None, None, 0), (n + 4, say("bb", 40000), None, "s", 0)]
    rows += [(None, say("cc", 30), "cc", "s", 0), rows[0], rows[0], (n + 5, "Ü", "bb", "s", 0), (n + 6, "É日", None, "s", 0)]
    return rows


def third():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def test_languages(spark):
    rows = invented()
    docs = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("x") for c in ("id", "held_out", "score", "langs")})
    got = langid.languages(docs, third()).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and truth[r.id] and r.lang_pred != "und"]
    assert len(held) > 60 and sum(r.lang_pred == truth[r.id] for r in held) >= 0.98 * len(held)
    assert all(r.held_out == (r.id is not None and zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)
    by_id = {r.id: r for r in got}
    assert [by_id[240 + k].lang_pred for k in (0, 1, 2)] == ["und"] * 3 and by_id[240].score == 0
    mixed = by_id[243]
    assert mixed.langs == ["aa", "cc"] and 0.55 < mixed.score < 0.75 and abs(sum(mixed.shares) - 1) < 1e-6
    assert by_id[244].langs == ["bb"] and by_id[None].lang_pred == "cc" and by_id[246].lang_pred in ("aa", "bb", "cc")
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_held_out_is_not_learnt(spark):
    """Neither the held-out texts nor their languages change what is learnt; a language that only they have is unknown."""
    rows = [(i, f"word{i} only", "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else "aa", "s", 0) for i in range(60)]
    names, logs = langid.learn(spark.createDataFrame(rows, DOC).where(~third()).select("lang", "text"))
    assert names == ["aa"]
    assert {r.lang_pred for r in langid.languages(spark.createDataFrame(rows, DOC), third()).collect()} == {"aa"}


def test_mixture_steps():
    """EM never lowers the likelihood, and the bound that spares a fit never hides a gain."""
    rng = np.random.default_rng(3)
    model = np.log(rng.dirichlet(np.ones(400) * 0.1, 4) + 1e-6).T.astype(np.float32)
    bags = []
    for k in range(40):
        q = rng.dirichlet(np.ones(4) * 0.4)
        at = rng.choice(400, 300, p=(np.exp(model) @ q) / (np.exp(model) @ q).sum())
        bags.append(np.unique(at, return_counts=True))
    q = langid.mixtures(bags, model, 1.0, 4.0)
    for (at, n), own in zip(bags, q, strict=True):
        value = lambda x: float(n @ np.log(np.exp(model[at].astype(float)) @ x))  # noqa: B023, E731
        price = 4.0 * np.log(n.sum() + 1)
        assert value(own) >= max(value(e) for e in np.eye(4)) - 1e-6
        for j in np.flatnonzero(own == 0):  # no larger set is worth its price
            start = 0.9 * own
            start[j] = 0.1
            more = langid.fit(np.exp(model[at].astype(float)), n.astype(float), np.zeros(len(at), int), 1, start[None], rounds=300, close=1e-9)[0]
            assert value(more) - value(own) <= price + 0.5


def test_languages_empty(empty):
    assert langid.languages(empty, third()).count() == 0


def test_nothing_learnt(spark):
    rows = [(1, "some text", None, "s", 0)]
    assert [(r.lang_pred, r.score) for r in langid.languages(spark.createDataFrame(rows, DOC), third()).collect()] == [("und", 0.0)]
