"""Queries by name, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import duck, frame

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables and views of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, name)


def query(oracle: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Registers a function of Tables under its name; oracle: SQL over ``{view}`` names."""

    def add(f: Callable[[Tables], DataFrame]) -> Query:
        run: Query = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = duck(oracle)
        return run

    return add
