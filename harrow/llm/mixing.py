"""Soft-membership mixing of document domains to target token weights.

A classifier trained on a bounded sample of a labelled table gives every document its posteriors over the
domains. A rate r >= 0 is then fitted for every document (how often it is taken, one at first), so that the
expected domain totals s = sum of r * tokens * posterior match the targets t: least squares on s - t, with a
light pull of the rates towards one, solved by projected gradient descent over 0 <= r <= ``most``. The residual is weighted by the inverse of the
documents' moment matrix, which makes one the right step size and a few rounds enough. Each round is one distributed sum over the table of
tokens and posteriors; a document's rate is a function of its posteriors and the residuals so far, so no rates
are stored between rounds and a lost executor costs nothing but its own tasks.

The labelled sample is the ``train_rows`` labels of documents at hand whose ids have the least hashes, or all labels
where there are fewer, at any size of the tables; totals and rates cover all rows.

Defined results: null and empty texts have no tokens, posteriors from the bias alone, and a rate like any
other; ids with a null or no label are not trained on; of rows with a labelled id, the least text is; without
labels the posteriors are equal; an empty table gives no rows. Extra columns are not read, and passed on by
``mix``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, free, least_hashed, pieces, row_hash, text_bytes, written
from .features import features, fit, logits, softmax

#: Share of all tokens each domain is to have.
TARGETS = {"clean": 0.96, "toxic": 0.03, "low": 0.01}


def domain(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The domain of a row of the labelled table."""
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 0, "low").when((F.col(quality) == 1) & (F.col(toxic) == 0), "clean")


def train(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", train_rows: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """labels: id, domain."""
    ids = docs.select(F.col(id_col).alias("id")).distinct()
    known = written(labels.select("id", "domain").where(F.col("domain").isin(domains)).join(ids, "id", "left_semi"), "labels")
    picked = least_hashed(known, F.col("id").cast("string"), train_rows, known.count())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").groupBy("id", "domain").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            got = [features(t) for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([i.tolist() for i, _ in got], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in got], pa.list_(pa.float32())), b.column(0)], ["at", "value", "domain"])

    sample = arrow_map(rows.select("domain", "text"), run, "at array<int>, value array<float>, domain string").toArrow()
    got = [(np.array(i.values, np.int32), np.array(v.values, np.float32)) for i, v in zip(sample.column("at"), sample.column("value"), strict=True)]
    y = np.array([domains.index(x) for x in sample.column("domain").to_pylist()], int)
    return fit(got, np.eye(len(domains))[y] if len(y) else np.zeros((0, len(domains))))


def posteriors(docs: DataFrame, weights: np.ndarray, bias: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, h, n_tokens (words), p (array of posteriors)."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = text_bytes(b.column(2))
            p = softmax(logits([features(t) for t in texts], *shared.value))
            n = pa.array([len((t or b"").split()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, pa.array(list(p), pa.list_(pa.float64()))], ["id", "h", "n_tokens", "p"])

    rows = docs.select(F.col(id_col).alias("id"), row_hash(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, h bigint, n_tokens bigint, p array<double>")


def _rate(steps: list[np.ndarray], pull: float, most: float) -> Column:
    """The rate after these steps: each takes off a price by domain, pulls the rate towards one and projects it."""
    r = F.lit(1.0)
    if steps:
        prices = F.array(*[F.array(*[F.lit(float(x)) for x in y]) for y in steps])
        cost = lambda y: sum(F.get("p", F.lit(j)) * F.get(y, F.lit(j)) for j in range(len(steps[0])))
        move = lambda acc, y: acc - (cost(y) + pull * (acc - 1)) / (1 + pull)
        r = F.aggregate(prices, r, lambda acc, y: F.least(F.lit(float(most)), F.greatest(F.lit(0.0), move(acc, y))))
    return r


def fit_rates(members: DataFrame, targets: list[float], rounds: int = 30, close: float = 1e-5, pull: float = 0.02, most: float = 4.0) -> tuple[Column, list[float]]:
    """The rate as a column over members (n_tokens, p), and the last residual as shares of all tokens. pull: the
    weight of staying near one, which decides where targets leave a choice and keeps a domain that hardly
    occurs from being bought with all documents; most: the greatest rate."""
    k = len(targets)
    at = [F.get("p", F.lit(j)) for j in range(k)]
    moments = members.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * at[i] * at[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
    total = float(moments["n"] or 0)
    if not total:
        return F.lit(1.0), [0.0] * k
    g = np.array([[moments[f"g{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)], float) / total
    inverse = np.linalg.inv(g + np.eye(k) * 0.01 * np.trace(g))
    goal = np.array(targets, float) / sum(targets)
    steps: list[np.ndarray] = []
    last = residual = np.full(k, np.inf)
    for _ in range(rounds):
        r = _rate(steps, pull, most)
        s = members.agg(*[F.sum(r * F.col("n_tokens") * at[j]).alias(f"s{j}") for j in range(k)]).first()
        residual = np.array([s[f"s{j}"] for j in range(k)], float) / total - goal
        if np.abs(residual - last).sum() < close:
            break
        last = residual
        steps.append(inverse @ residual)
    return _rate(steps, pull, most), residual.tolist()


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 6000) -> DataFrame:
    """Per row: id, h, n_tokens, p_<domain>, rate. labels: id, domain."""
    domains = list(targets)
    weights, bias = train(docs, labels, domains, id_col, text_col, train_rows)
    members = written(posteriors(docs, weights, bias, id_col, text_col), "members")
    rate, _ = fit_rates(members, [targets[d] for d in domains])
    return members.select("id", "h", "n_tokens", *[F.get("p", F.lit(j)).alias(f"p_{d}") for j, d in enumerate(domains)], rate.alias("rate"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 6000) -> DataFrame:
    """docs, all columns, each row as often as its rate says: the whole part of it, and once more with the
    probability of the rest, by a hash of id and text."""
    m = mixture(docs, labels, targets, id_col, text_col, train_rows)
    chance = F.pmod(F.xxhash64(F.col("id").cast("string"), "h", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    times = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    own_id, own_h, own_times, own_n = free(docs, "__id", "__h", "__times", "__n")
    taken = m.select(F.col("id").alias(own_id), F.col("h").alias(own_h), times.alias(own_times)).where(F.col(own_times) > 0).distinct()
    on = F.col(id_col).eqNullSafe(F.col(own_id)) & (row_hash(F.col(text_col)) == F.col(own_h))
    return docs.join(taken, on).withColumn(own_n, F.explode(F.sequence(F.lit(1), own_times))).drop(own_id, own_h, own_times, own_n)
