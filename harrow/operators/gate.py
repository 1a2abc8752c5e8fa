"""Promotion gate over captured fixtures, and the run row of a batch of responses."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import canonical, external_key, is_valid, variant
from ..functions.text import blocked_reason, fetch_outcome

MIN_FIXTURES = 3


def gate_report(fixtures: DataFrame, schema: dict[str, Any]) -> DataFrame:
    """A row per fixture (source_id, fixture, items array<variant>, expected array<variant> or null, error)."""
    f = fixtures.withColumn("n", F.coalesce(F.size("items"), F.lit(0))).withColumn("n", F.when(F.col("items").isNull(), 0).otherwise(F.col("n")))
    valid = F.size(F.filter("items", lambda v: is_valid(v, schema)))
    f = f.withColumn("valid", F.when(F.col("items").isNull(), 0).otherwise(valid))
    texts = lambda c: F.transform(c, canonical)
    rule = F.when(F.col("error").isNotNull(), "exec-error").when(F.col("n") == 0, "empty").when(F.col("valid") < F.col("n"), "schema-invalid").when(F.col("expected").isNotNull() & (F.to_json(texts("expected")) != F.to_json(texts("items"))), "expected-mismatch")
    return f.select("source_id", "fixture", F.col("n").alias("items"), "valid", rule.alias("failure"))


def gate_totals(report: DataFrame) -> DataFrame:
    s = lambda c: F.sum(c).cast("long")
    a = report.groupBy("source_id").agg(F.count("*").alias("fixtures"), s("items").alias("items"), s("valid").alias("valid"), F.count("failure").alias("failures"))
    return a.withColumn("invalid_rate", F.round(F.when(F.col("items") == 0, 1.0).otherwise((F.col("items") - F.col("valid")) / F.col("items")), 6))


def gate_verdict(report: DataFrame) -> DataFrame:
    few = F.col("fixtures") < MIN_FIXTURES
    outcome = F.when(F.col("items") == 0, "empty").when(F.col("valid") < F.col("items"), "schema_invalid").otherwise("ok")
    return gate_totals(report).select("source_id", "fixtures", (~few & (F.col("failures") == 0)).alias("passed"), few.alias("too_few"), outcome.alias("outcome"))


def field_nulls(items: Column, required: tuple[str, ...]) -> Column:
    """The share of an array's items in which each field is null or absent, for the required fields and all that occur,
    by name; without items the required ones are all absent. Items that are no objects have no fields."""
    absent = F.map_from_arrays(F.array(*map(F.lit, required)).cast("array<string>"), F.array(*[F.lit(1.0)] * len(required)).cast("array<double>"))

    def rates(maps: Column) -> Column:
        seen = F.flatten(F.transform(maps, lambda m: F.map_keys(F.map_filter(m, lambda _, v: ~F.is_variant_null(v)))))
        names = F.array_sort(F.array_distinct(F.concat(F.array(*map(F.lit, required)).cast("array<string>"), F.flatten(F.transform(maps, F.map_keys)))))
        # How often a name is there, out of as many items: one pass over the names that are.
        there = lambda n: F.size(F.filter(seen, lambda s: s == n))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.round(1 - there(n) / F.size(maps), 6)))

    maps = F.transform(items, lambda v: F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    return F.when(F.size(items) > 0, F.get(F.transform(F.array(maps), rates), F.lit(0))).otherwise(absent)


def process(responses: DataFrame, schema: dict[str, Any], array_path: str = "$.items", keep: tuple[str, ...] = (), required: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(run rows, valid keyed items) of a batch: classify, extract the item array, validate, key. An item
    without a key counts as invalid. A run says why it is not ok: the reason of a block, the status of a failed
    fetch, or how many of its items failed. keep: columns of the responses that both carry (source, tier, timings);
    with required fields the run rows have field_nulls, of all items of the response."""
    r = responses.withColumn("fetched", fetch_outcome(F.col("status"), F.col("content_type"), F.col("body")))
    r = r.withColumn("items", F.when(F.col("fetched") == "ok", F.try_variant_get(variant(F.col("body")), array_path, "array<variant>")))
    good = lambda v: is_valid(v, schema) & external_key(v).isNotNull()
    r = r.withColumn("n", F.when(F.col("items").isNull(), 0).otherwise(F.size("items"))).withColumn("kept", F.filter("items", good)).withColumn("valid", F.when(F.col("items").isNull(), 0).otherwise(F.size("kept")))
    outcome = F.when(F.col("fetched") != "ok", F.col("fetched")).when(F.col("n") == 0, "empty").when(F.col("valid") < F.col("n"), "schema_invalid").otherwise("ok")
    why = F.when(F.col("fetched") == "blocked", blocked_reason(F.col("status"), F.col("content_type"), F.col("body"))).when(F.col("fetched") == "fetch_error", F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("none"))))
    why = why.when(F.col("valid") < F.col("n"), F.format_string("%d of %d items failed validation", F.col("n") - F.col("valid"), F.col("n")))
    nulls = [] if required is None else [F.when(F.col("fetched") == "ok", field_nulls(F.coalesce("items", F.array().cast("array<variant>")), required)).alias("field_nulls")]
    runs = r.select("id", outcome.alias("outcome"), F.col("n").alias("items"), F.col("valid").alias("valid_items"), (outcome == "ok").alias("complete"), why.alias("error"), *nulls, *keep)
    items = r.select("id", *keep, F.posexplode("kept").alias("item_idx", "payload")).withColumn("external_key", external_key(F.col("payload")))
    return runs, items


def escalate(http: DataFrame, browser: DataFrame) -> DataFrame:
    """The browser's outcome where http was blocked and there is a browser attempt, else that of http."""
    b = browser.select("id", F.col("outcome").alias("b_outcome"), F.col("error").alias("b_error"))
    j = http.join(b, "id", "left")
    up = (F.col("outcome") == "blocked") & F.col("b_outcome").isNotNull()
    return j.select("id", F.when(up, F.col("b_outcome")).otherwise(F.col("outcome")).alias("outcome"), F.when(up, "browser").otherwise("http").alias("tier"), up.alias("escalated"), F.when(up & (F.col("b_outcome") != "ok"), F.concat_ws("; ", "error", "b_error")).otherwise(F.col("error")).alias("error"))
