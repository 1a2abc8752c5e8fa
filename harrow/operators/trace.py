"""Traces of repair agents, as data: numbered steps, caps, call and result pairs, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.json_outline import with_outline

#: Tool calls allowed by kind of run.
CAPS = {"compile": 12, "repair": 8}


def numbered(steps: DataFrame) -> DataFrame:
    """Steps of a run (run_id, pos) numbered from one."""
    return steps.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("pos")))


def capped(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """How many calls of each run are within its cap."""
    cap = F.when(F.col("kind") == "repair", CAPS["repair"]).otherwise(CAPS["compile"])
    a = steps.groupBy("run_id").agg(F.count("*").alias("calls"))
    return a.join(runs.select(F.col("id").alias("run_id"), "kind"), "run_id").select("run_id", "kind", F.least("calls", cap).cast("long").alias("done"), (F.col("calls") > cap).alias("stopped"))


def paired(turns: DataFrame) -> DataFrame:
    """Calls with their results, by run and call id; a call without a result has null."""
    c = turns.where("role = 'call'").select("run_id", "call_id", F.col("text").alias("call"))
    r = turns.where("role = 'result'").select("run_id", "call_id", F.col("text").alias("result"))
    return c.join(r, ["run_id", "call_id"], "left")


def cost(runs: DataFrame, rates: DataFrame) -> DataFrame:
    """runs (model, tokens_in, tokens_out) with cost_usd by the rate per million tokens; null without a rate."""
    exact = lambda c: F.col(c).cast("decimal(12,4)")  # noqa: E731  halves round up, which doubles cannot promise
    count = lambda c: F.col(c).cast("decimal(12,0)")
    usd = ((count("tokens_in") * exact("usd_in") + count("tokens_out") * exact("usd_out")) * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(20,10)")
    return runs.join(F.broadcast(rates), "model", "left").select(*runs.columns, F.round(usd, 4).cast("decimal(10,4)").alias("cost_usd"))


def probe_rank(responses: DataFrame, most: int = 40) -> DataFrame:
    """The data requests of each page: JSON or script responses that are no assets or documents, the first so
    many, the largest first."""
    asset = r"(?i)\.(png|jpe?g|gif|svg|webp|avif|woff2?|ttf|otf|eot|css|ico|mp4|webm)(\?|$)"
    seen = responses.where(F.col("content_type").rlike("(?i)json|javascript") & ~F.col("url").rlike(asset))
    first = seen.withColumn("k", F.row_number().over(Window.partitionBy("page").orderBy("pos"))).where(F.col("k") <= most)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy(F.col("bytes").desc(), "pos"))).select("page", "rank", "url", "bytes")


def probe_shape(responses: DataFrame, body: str = "body") -> DataFrame:
    """responses with what their JSON bodies hold: arrays (of objects, the longest first: path, length, keys), or the
    value's shape where there are none; both null for what is no JSON."""
    o = with_outline(responses, body, "__outline")
    some = F.size("__outline.arrays") > 0
    return o.withColumns({"arrays": F.when(some, F.col("__outline.arrays")), "shape": F.when(~some, F.col("__outline.shape"))}).drop("__outline")
