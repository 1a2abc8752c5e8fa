"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. Their accuracies are not known;
expectation-maximisation estimates them, and the share of good documents, from the counts of vote patterns over
all documents (a two-class model with votes independent given the class; Dawid and Skene 1979). The number of
patterns is bounded by the number of labellers, so the counts are a small table. The posterior of a document's
pattern is its label, and the posteriors of a bounded sample of documents train a hashed linear scorer
(features.py) that then scores every document.

The sample is the ``train_rows`` distinct texts of the least hashes, or all texts where there are fewer, at any size
of the table; labeller counts and scores cover all rows.

Defined results: null and wordless texts score 0 and are not kept; each row is scored by itself, so repeated
rows score alike; an empty table gives no rows. Extra columns are passed on by ``keep_good`` and not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, least_hashed, parallelism, pieces, text_bytes
from .features import features, fit, logits, rates, shapes_of, softmax

#: Labeller: rate it looks at, good up to (None: it never votes good), bad from. Those with a minus look at the
#: rate's negative. Each kind of junk is seen by more than one of them.
LABELLERS = [
    ("symbols", None, 0.25),
    ("-plain", -0.85, -0.5),
    ("upper", None, 0.4),
    ("exclaim", None, 0.25),
    ("adjacent", 0.08, 0.3),
    ("repeats", None, 0.5),
    ("-distinct", -0.45, -0.2),
    ("digits", None, 1.0),
]
REPETITION = ("adjacent", "repeats", "-distinct")
LONG = 10  # fewer words than this and the labellers of repetition do not vote


def votes(text: bytes | None) -> str:
    """A letter for each labeller: g, b or a dash."""
    shapes = shapes_of(text or b"")
    if not shapes:
        return "-" * len(LABELLERS)
    of, n, out = rates(text, shapes), sum(shapes.values()), ""
    for name, good, bad in LABELLERS:
        v = -of[name[1:]] if name[0] == "-" else of[name]
        out += "-" if name in REPETITION and n < LONG else "b" if v >= bad else "g" if good is not None and v <= good else "-"
    return out


def posteriors(counts: dict[str, int], rounds: int = 200, prior: float = 1.0) -> dict[str, float]:
    """Probability of good for each vote pattern, by EM: the share of good documents and how often each labeller
    votes good, bad or nothing on good and on bad ones, all from the counts (and prior of each vote). The classes
    get their names from the start, where a bad vote makes a document bad; a pattern without one is never held to
    be more bad than good, so that a corpus without bad documents is not split along some other line."""
    patterns = sorted(counts)
    if not patterns:
        return {}
    n = np.array([counts[p] for p in patterns], float)
    shown = np.array([[["g", "b", "-"].index(x) for x in p] for p in patterns])
    accused = np.array(["b" in p for p in patterns])
    good = np.where(accused, 0.02, 0.98)
    for _ in range(rounds):
        z = []
        for c in (good, 1 - good):
            m = n * c
            log = np.full(len(patterns), np.log((m.sum() + prior) / (n.sum() + 2 * prior)))
            for j in range(shown.shape[1]):
                share = np.bincount(shown[:, j], m, 3) + prior
                log += np.log(share / share.sum())[shown[:, j]]
            z.append(log)
        new = 1 / (1 + np.exp(np.clip(z[1] - z[0], -50, 50)))
        new = np.where(accused, new, np.maximum(new, 0.5))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(patterns, good.tolist(), strict=True))


def accuracies(counts: dict[str, int], good: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Per labeller: the estimated share of right votes on good and on bad documents it votes on."""
    out = {}
    for j, (name, _, _) in enumerate(LABELLERS):
        s = lambda v, c: sum(n * (good[p] if c else 1 - good[p]) for p, n in counts.items() if p[j] == v)  # noqa: B023, E731
        out[name] = (s("g", 1) / max(s("g", 1) + s("b", 1), 1e-9), s("b", 0) / max(s("g", 0) + s("b", 0), 1e-9))
    return out


def vote_counts(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Vote patterns over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counter()
        for b in pieces(batches):
            c.update(map(votes, text_bytes(b.column(0))))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["pattern", "n"])

    counted = arrow_map(docs.select(F.col(text_col).alias("text")), run, "pattern string, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {r["pattern"]: r["n"] for r in counted.collect()}  # at most 3 ** labellers


def train(docs: DataFrame, text_col: str = "text", train_rows: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of the scorer (class 1: good)."""
    counts = vote_counts(docs, text_col)
    good = posteriors(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = [t for t in text_bytes(b.column(0)) if t and not t.isspace()]
            rows = [features(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i.tolist() for i, _ in rows], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in rows], pa.list_(pa.float32())), pa.array([good[votes(t)] for t in texts], pa.float64())], ["at", "value", "good"]
            )

    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    picked = least_hashed(texts, F.col("text"), train_rows, sum(counts.values()))
    sample = arrow_map(picked.repartition(parallelism(docs.sparkSession)), run, "at array<int>, value array<float>, good double").toArrow()
    rows = [(np.array(i.values, np.int32), np.array(v.values, np.float32)) for i, v in zip(sample.column("at"), sample.column("value"), strict=True)]
    g = sample.column("good").to_numpy()
    return fit(rows, np.stack([1 - g, g], axis=1))


def scores(texts: list[bytes | None], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    p = softmax(logits([features(t) for t in texts], weights, bias))
    return np.array([x if t and not t.isspace() else 0.0 for t, x in zip(texts, p[:, 1] if len(p) else [], strict=True)])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 6000, least: float = 0.5) -> DataFrame:
    """Per row: id, score (probability of good), kept."""
    weights, bias = train(docs, text_col, train_rows)
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            s = scores(text_bytes(b.column(1)), *shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(s >= least)], ["id", "score", "kept"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, score double, kept boolean")


def keep_good(docs: DataFrame, text_col: str = "text", train_rows: int = 6000, least: float = 0.5) -> DataFrame:
    """docs, all columns, without the rows that score under least."""
    weights, bias = train(docs, text_col, train_rows)
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield b.filter(pc.greater_equal(pa.array(scores(text_bytes(b.column(at)), *shared.value), pa.float64()), least))

    return arrow_map(docs, run, docs.schema)
