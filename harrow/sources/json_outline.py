"""Outlines of JSON bodies: the shape of the value and its arrays of objects, in one Arrow pass."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How deep, how many keys, how long a sample, how many arrays.
DEPTH, KEYS, SAMPLE, ARRAYS = 6, 40, 60, 8
OUTLINE = "struct<shape:string,arrays:array<struct<path:string,length:int,keys:array<string>>>>"


def shape(v: Any, depth: int = 0) -> Any:
    """v with every array cut to its first element and a count, and long texts cut."""
    if depth > DEPTH:
        return "…"
    if isinstance(v, list):
        return [shape(v[0], depth + 1), f"…{len(v)} items"] if v else []
    if isinstance(v, dict):
        return {k: shape(x, depth + 1) for k, x in v.items()}
    if isinstance(v, str):
        t = re.sub(r"\s+", " ", v).strip()
        return t if len(t) <= SAMPLE else t[:SAMPLE] + "…"
    return v


def arrays(v: Any) -> list[dict[str, Any]]:
    """The arrays of objects in v, the longest first and in order of appearance among equals."""
    found, todo = [], [("$", v, 0)]
    while todo:
        path, x, depth = todo.pop()
        if depth > DEPTH:
            continue
        if isinstance(x, list) and x:
            if isinstance(x[0], dict):
                found.append({"path": path, "length": len(x), "keys": list(x[0])[:KEYS]})
            todo.append((f"{path}[0]", x[0], depth + 1))
        elif isinstance(x, dict):
            todo += [(f"{path}.{k}", y, depth + 1) for k, y in reversed(x.items())]
    return sorted(found, key=lambda a: -a["length"])[:ARRAYS]


def outline(body: str | None) -> dict[str, Any] | None:
    try:
        v = json.loads(body) if body and body.lstrip()[:1] in ("{", "[") else None
    except ValueError:
        return None
    return None if v is None else {"shape": json.dumps(shape(v), ensure_ascii=False, separators=(",", ":")), "arrays": arrays(v)}


def with_outline(df: DataFrame, body: str, name: str = "outline") -> DataFrame:
    """df with the outline of its JSON bodies; null for what is not JSON."""

    @F.pandas_udf(OUTLINE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            got = [outline(b) or {"shape": None, "arrays": None} for b in s]
            yield pd.DataFrame(got, columns=["shape", "arrays"])

    out = df.withColumn(name, run(F.col(body)))
    return out.withColumn(name, F.when(F.col(f"{name}.shape").isNotNull(), F.col(name)))
