"""Languages of documents, several to a text where need be.

Model. Texts are lower-cased, what is no letter in ASCII becomes one blank, and the overlapping n-grams of ``N`` bytes
are hashed into 2**BITS bins. Every training row is counted, in one distributed pass: a language's model is its share
of each bin, smoothed. The model grows with the languages (half a MiB each in a worker, twice that at the driver), not
with the corpus.

Inference. A document is a bag of n-grams drawn from a mixture of languages with unknown proportions q:

    L(q) = weight * sum over n-grams of count * log(sum over languages of q * share)

Expectation-maximisation raises L: a language's new proportion is the mean probability that it has drawn an n-gram.
The set of languages is chosen by penalised likelihood: from the best single one on, languages are tried in the order
of how fast their proportion would raise L, and one joins the set if the fitted L of the larger set gains more than
``penalty`` * log(n-grams); so it goes on until none does. L is concave, so that its slope at q bounds what any further language can gain; where
that bound is below the price, as for most texts in one language, no fit is needed and none is made. ``weight`` is below
one as overlapping n-grams are not independent.

The language of the largest proportion is the prediction, its proportion the score.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text where nothing was
learnt; ties go to the language first in order; empty texts, repeated rows and rows without an id are scored like any
other; rows without a text or language are not learnt from; an empty table gives no rows. Texts are read whole,
and counted in slices, so that a long one takes memory for its bytes and distinct n-grams. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces, text_bytes

N, BITS = 4, 17
#: Bytes that are no letters in ASCII become blanks; all others stand.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLANKS = re.compile(rb" {2,}")
SLICE = 1 << 20


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bins of a text's n-grams and how often each occurs."""
    low = text if text.isascii() else text.decode(errors="replace").lower().encode()
    clean = b" " + BLANKS.sub(b" ", low.translate(LETTERS)).strip() + b" "
    if len(clean) < N:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = None
    for i in range(0, len(clean) - N + 1, SLICE):
        a = np.frombuffer(clean, np.uint8, min(SLICE + N - 1, len(clean) - i), i).astype(np.uint32)
        h = np.zeros(len(a) - N + 1, np.uint32)
        for j in range(N):
            h = h * np.uint32(0x01000193) + a[j : len(a) - N + 1 + j]
        bins = ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
        if total is None and len(clean) <= SLICE:
            return np.unique(bins, return_counts=True)
        total = (0 if total is None else total) + np.bincount(bins, minlength=1 << BITS)
    used = np.flatnonzero(total)
    return used, total[used]


def has_letter(text: bytes) -> bool:
    if re.search(rb"[A-Za-z]", text):
        return True
    return not text.isascii() and any(map(str.isalpha, text.decode(errors="replace")))


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log shares of the bins (languages by bins). rows: lang, text, none of them null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in pieces(batches):
            for lang, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(1 << BITS, np.int64)
                at, n = grams(t)
                sums[lang][at] += n
            if len(sums) > 64:
                yield from map(counted, sums.items())
                sums = {}
        yield from map(counted, sums.items())

    def counted(item: tuple[str, np.ndarray]) -> pa.RecordBatch:
        at = np.flatnonzero(item[1])
        return pa.RecordBatch.from_arrays([pa.array([item[0]] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(item[1][at])], ["lang", "bin", "n"])

    sums = arrow_map(rows, run, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    got = sums.toArrow()  # 2**BITS rows a language at most
    langs, which = np.unique(np.array(got.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True) if got.num_rows else (np.zeros(0, str), np.zeros(0, np.int64))
    counts = np.zeros((len(langs), 1 << BITS))
    counts[which, got.column("bin").to_numpy()] = got.column("n").to_numpy()
    smooth = 0.1
    shares = (counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * (1 << BITS))
    return langs.tolist(), np.log(shares).astype(np.float32)


def fit(shares: np.ndarray, n: np.ndarray, doc: np.ndarray, docs: int, q: np.ndarray, rounds: int = 40, close: float = 1e-3) -> np.ndarray:
    """Proportions (documents by languages) by EM, from q, whose zeros stay. shares: of the n-grams (rows), n: how often
    each occurs, doc: where (ascending, every document has rows)."""
    starts = np.searchsorted(doc, np.arange(docs))
    total = np.add.reduceat(n, starts)[:, None]
    for _ in range(rounds):
        p = shares * q[doc]
        p *= (n / p.sum(axis=1))[:, None]
        new = np.add.reduceat(p, starts, axis=0) / total
        moved = np.abs(new - q).max()
        q = new
        if moved < close:
            break
    return q


def mixtures(bags: list[tuple[np.ndarray, np.ndarray]], model: np.ndarray, weight: float, penalty: float) -> np.ndarray:
    """Proportions of each bag (not empty) over the languages."""
    doc = np.repeat(np.arange(len(bags)), [len(at) for at, _ in bags])
    n = np.concatenate([c for _, c in bags]).astype(np.float64)
    logs = model[np.concatenate([at for at, _ in bags])].astype(np.float64)
    starts = np.searchsorted(doc, np.arange(len(bags)))
    total = np.add.reduceat(n, starts)
    single = np.add.reduceat(n[:, None] * logs, starts, axis=0)
    q = np.eye(model.shape[1])[single.argmax(axis=1)]
    now = single.max(axis=1)
    shares = np.exp(logs - logs.max(axis=1, keepdims=True))
    offset = np.add.reduceat(n * logs.max(axis=1), starts)
    price = penalty * np.log(total + 1)
    live, refused = np.arange(len(bags)), np.zeros(q.shape, bool)  # refused: with the set as it stands
    while len(live):
        rows = np.isin(doc, live) if len(live) < len(bags) else np.ones(len(doc), bool)
        d, own, c = np.searchsorted(live, doc[rows]), shares[rows], n[rows]
        first = np.searchsorted(d, np.arange(len(live)))
        slope = np.add.reduceat(own * (c / (own * q[live][d]).sum(axis=1))[:, None], first, axis=0)
        slope[(q[live] > 0) | refused[live]] = 0
        going = weight * (slope.max(axis=1) - total[live]) > price[live]
        if not going.any():
            break
        keep = going[d]
        d, own, c = np.cumsum(going)[d[keep]] - 1, own[keep], c[keep]
        live, more = live[going], slope[going].argmax(axis=1)
        start = 0.9 * q[live]
        start[np.arange(len(live)), more] = 0.1
        fitted = fit(own, c, d, len(live), start)
        first = np.searchsorted(d, np.arange(len(live)))
        gained = offset[live] + np.add.reduceat(c * np.log((own * fitted[d]).sum(axis=1)), first)
        better = weight * (gained - now[live]) > price[live]
        refused[live[~better], more[~better]] = True
        q[live[better]], now[live[better]] = fitted[better], gained[better]
        refused[live[better]] = False
    return q


def languages(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", weight: float = 0.25, penalty: float = 4.0) -> DataFrame:
    """id, held_out, lang_pred, score, langs and shares (the chosen set, largest first) of every row; learnt from the
    rows that held_out is false for."""
    training = docs.where(~held_out & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    names, logs = learn(training)
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs.T))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    fields = ["id", "held_out", "lang_pred", "score", "langs", "shares"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 256):
            texts = text_bytes(b.column(2))
            bags = [grams(t) if names and t and has_letter(t) else None for t in texts]
            known = [i for i, x in enumerate(bags) if x is not None and len(x[0])]
            found: list[list[tuple[str, float]]] = [[] for _ in texts]
            if known:
                for i, q in zip(known, mixtures([bags[i] for i in known], shared.value, weight, penalty), strict=True):
                    order = sorted(np.flatnonzero(q > 0).tolist(), key=lambda j: (-q[j], j))
                    found[i] = [(names[j], min(1.0, float(q[j]))) for j in order]
            columns = [pa.array([x[0][0] if x else "und" for x in found], pa.string()), pa.array([x[0][1] if x else 0.0 for x in found], pa.float64()), pa.array([[k for k, _ in x] for x in found], pa.list_(pa.string())), pa.array([[v for _, v in x] for x in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], fields)

    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, langs array<string>, shares array<double>")
