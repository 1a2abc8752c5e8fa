"""Several tables at once: all of a change becomes visible, or none of it.

A publication is a folder with numbered lists. A list names, for each table, the folders that make it up. A change
stages its tables in folders of its own, which nobody reads, and then writes the next list with a create that fails if
the list is there: the step that makes the change count, and that lets one of two writers win. A reader takes the
last list and sees the tables as they were when it was written, whatever is staged meanwhile; a writer that stops before
its list leaves folders that are never read (``tidy`` removes them).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..store import listed, remove
from .extractors import code_hash, violations
from .gate import gate_report, gate_verdict
from .lifecycle import next_version, promote


class Conflict(RuntimeError):
    """Another writer has published since this one began."""


class Publication:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _lists(self) -> list[int]:
        return sorted(int(n.removeprefix("n").removesuffix(".json")) for n in listed(self.spark, f"{self.folder}/lists") if n.startswith("n"))

    def _list(self, number: int) -> dict[str, Any]:
        if not number:
            return {}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.folder}/lists/n{number:012}.json", wholetext=True).collect()))

    def number(self) -> int:
        """The last list's; nought where nothing is published."""
        return max(self._lists(), default=0)

    def read(self, table: str, number: int | None = None) -> DataFrame | None:
        """A table as of the last list, or of an earlier one; None where it has never been published."""
        entry = self._list(self.number() if number is None else number).get(table)
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(*entry["paths"]) if entry else None

    def publish(self, change: Callable[[dict[str, DataFrame | None]], dict[str, DataFrame]], names: list[str], append: tuple[str, ...] = ()) -> int:
        """Stages what change makes of the named tables, each whole or, for those in append, only the new rows, and
        then publishes them together. Returns the list's number."""
        before = self.number()
        held = self._list(before)
        made = change({n: self.read(n, before) for n in names})
        stage = f"{self.folder}/stage-{uuid.uuid4().hex}"
        new = dict(held)
        for name, rows in made.items():
            rows.write.parquet(f"{stage}/{name}")
            earlier = held[name]["paths"] if name in append and name in held else []
            new[name] = {"paths": [*earlier, f"{stage}/{name}"], "schema": json.loads(rows.schema.json())}
        self._create(f"{self.folder}/lists/n{before + 1:012}.json", json.dumps(new))
        return before + 1

    def _create(self, uri: str, text: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(uri)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path.getParent())
        # Written beside it under a name of its own and renamed, so that a list is whole as soon as it is there; the
        # rename does not replace a list that another writer has put there.
        own = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/lists/.{uuid.uuid4().hex}")
        out = fs.create(own, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            contexts = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            contexts.rename(own, path, none)
        except Exception as e:
            fs.delete(own, False)
            if fs.exists(path):
                raise Conflict(uri) from e
            raise

    def tidy(self, keep: int = 2) -> None:
        """Removes all but the last lists, and staged folders that none of these names. Not beside a running writer."""
        lists = self._lists()
        for n in lists[:-keep]:
            remove(self.spark, f"{self.folder}/lists/n{n:012}.json")
        used = {p.rsplit("/", 1)[0].rsplit("/", 1)[1] for n in lists[-keep:] for e in self._list(n).values() for p in e["paths"]}
        for name in listed(self.spark, self.folder):
            if name.startswith("stage-") and name not in used:
                remove(self.spark, f"{self.folder}/{name}")


def register(p: Publication, source: DataFrame, code: str, fixtures: DataFrame, captured: DataFrame, schema: dict[str, Any]) -> tuple[bool, DataFrame]:
    """Checks code, runs the gate over the source's fixtures (as gate_report wants them), and if it passes publishes the
    source, its captured pages and the adapter as the active one, together. (whether it passed, the gate's verdict).

    source: one row with source_id; adapters get an id from the source and version."""
    if bad := violations(code):
        raise ValueError(f"extractor rejected: {bad}")
    verdict = gate_verdict(gate_report(fixtures, schema))
    first = verdict.first()
    if first is None or not first["passed"]:
        return False, verdict

    def change(now: dict[str, DataFrame | None]) -> dict[str, DataFrame]:
        ids = source.select("source_id")
        kinds = "id string, source_id " + dict(source.dtypes)["source_id"] + ", version int, status string, code_hash string"
        held = now["adapter"] if now["adapter"] is not None else p.spark.createDataFrame([], kinds)
        new = next_version(held, ids).select(F.concat_ws("-", F.col("source_id").cast("string"), F.col("next_version").cast("string")).alias("id"), "source_id", F.col("next_version").alias("version"), F.lit("draft").alias("status"), F.lit(code_hash(code)).alias("code_hash"))
        both = held.unionByName(new)
        adapters = promote(both, new).join(both.select("id", "code_hash"), "id")
        others = [now["source"].join(ids, "source_id", "left_anti")] if now["source"] is not None else []
        sources = source
        for o in others:
            sources = o.unionByName(source, allowMissingColumns=True)
        return {"source": sources, "fixture": captured, "adapter": adapters}

    p.publish(change, ["source", "fixture", "adapter"], append=("fixture",))
    return True, verdict
