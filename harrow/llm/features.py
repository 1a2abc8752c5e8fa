"""Hashed text features and linear models over them."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np

BITS = 18
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"([^\x20\x09-\x0D])\1+")
#: Lower-case letters and bytes beyond ASCII stay, capitals become small, all else becomes a blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PLAIN = [s + p for s in (b"A", b"Aa", b"a") for p in (b"", b".", b",", b";", b":", b"?")]
SYMBOLS = b"#*$%&|<>"
#: Rates are cut into these steps before they are hashed.
STEPS = [0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7]


@lru_cache(1 << 14)
def _collapsed(shape: bytes) -> bytes:
    return _RUNS.sub(rb"\1", shape)


def shapes_of(text: bytes) -> Counter:
    """Word shapes and how often they occur: letters as A and a, digits as 0, repeated characters once."""
    out = Counter()
    for s, c in Counter(text.translate(_SHAPE).split()).items():
        out[_collapsed(s) if len(s) < 64 else _RUNS.sub(rb"\1", s)] += c
    return out


def rates(text: bytes, shapes: Counter) -> dict[str, float]:
    """What the heuristics look at, each per word; lines: per line."""
    h = np.fromiter(map(hash, text.split()), np.int64)
    n = max(len(h), 1)
    grams = np.zeros(max(len(h) - 4, 0), np.int64)
    for j in range(5):
        grams = grams * 1_000_003 + h[j : j + len(grams)]
    # Most texts have no gram twice; only the others sort theirs.
    times = np.unique(grams, return_counts=True)[1] if len(set(grams.tolist())) < len(grams) else grams[:0]
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return {
        "plain": sum(shapes[s] for s in _PLAIN if s in shapes) / n,
        "symbols": (len(text) - len(text.translate(None, SYMBOLS))) / n,
        "upper": sum(c for s, c in shapes.items() if s.isupper()) / n,
        "exclaim": text.count(b"!") / n,
        "adjacent": np.count_nonzero(h[1:] == h[:-1]) / n,
        "distinct": len(set(h.tolist())) / n,
        "repeats": int(times[times > 1].sum()) / n,
        "lines": 1 - len(set(lines)) / max(len(lines), 1),
        "digits": (len(text) - len(text.translate(None, b"0123456789"))) / n,
    }


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's hashed features: its distinct words, and its word shapes and rates in steps."""
    text = text or b""
    shapes = shapes_of(text)
    n = max(sum(shapes.values()), 1)
    own = np.fromiter(map(zlib.crc32, set(text.translate(_LETTERS).split())), np.uint32)
    stepped = [b"%s %d" % (s, bisect_left(STEPS, c / n)) for s, c in shapes.most_common(16)]
    stepped += [b"%s=%d" % (k.encode(), bisect_left(STEPS, v)) for k, v in rates(text, shapes).items()]
    other = np.fromiter(map(zlib.crc32, stepped), np.uint32)
    values = np.concatenate([np.full(len(own), 0.2), np.full(len(other), 0.25)])
    return (np.concatenate([own, other]) >> (32 - BITS)).astype(np.int32), values.astype(np.float32)


def logits(rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Scores by row and class; weights: 2**BITS by classes."""
    return np.array([bias + v @ weights[i] for i, v in rows]) if rows else np.zeros((0, len(bias)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True, initial=-np.inf)) if len(z) else z
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, steps: int = 150, rate: float = 0.3, decay: float = 0.1, least_rows: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on soft targets (rows by classes), by Adam over the whole (bounded) sample. Features of
    fewer than least_rows rows keep weight zero."""
    k = targets.shape[1]
    weights, bias = np.zeros((1 << BITS, k), np.float32), np.zeros(k)
    if not rows:
        return weights, bias
    at = np.concatenate([i for i, _ in rows])
    used, at = np.unique(at, return_inverse=True)
    values = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    often = np.bincount(at) >= min(least_rows, len(rows))
    at, values, row = (np.cumsum(often) - 1)[at[often[at]]], values[often[at]], row[often[at]]
    used = used[often]
    w, m, s = (np.zeros((len(used), k)) for _ in range(3))
    mb, sb = np.zeros(k), np.zeros(k)
    for t in range(1, steps + 1):
        z = np.stack([np.bincount(row, values * w[at, j], len(rows)) for j in range(k)], axis=1) + bias
        err = (softmax(z) - targets) / len(rows)
        g = np.stack([np.bincount(at, values * err[row, j], len(used)) for j in range(k)], axis=1) + decay * w / len(rows)
        gb = err.sum(axis=0)
        for x, gx, mx, sx in ((w, g, m, s), (bias, gb, mb, sb)):
            mx += 0.1 * (gx - mx)
            sx += 0.001 * (gx * gx - sx)
            x -= rate * (mx / (1 - 0.9**t)) / (np.sqrt(sx / (1 - 0.999**t)) + 1e-8)
    weights[used] = w
    return weights, bias
