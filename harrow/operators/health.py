"""Rolling health of extractors: window reports, canary verdicts and the actions that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import SPLIT, busiest, ranged

#: Fixed values of the health rules.
WINDOW = 20
MAX_INVALID_RATE = 0.20
MAX_NULL_RATE = 0.15
YIELD_FACTOR = 0.6
STREAK = 3
FAILURES = ("empty", "exec_error")
CANARY_RUNS = 20
CANARY_WINDOW = 100
CANARY_YIELD = 0.9
MAX_FAILED_REPAIRS = 3


def recent(runs: DataFrame, n: int = WINDOW, key: str = "source_id", canary: bool | None = None) -> DataFrame:
    """The last n runs of each key, newest first by id, numbered rn. The rank limit runs before the shuffle."""
    if canary is not None:
        runs = runs.where(F.col("canary") if canary else ~F.col("canary"))
    w = Window.partitionBy(key).orderBy(F.col("id").desc())
    return runs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def _rate(num: Column, den: Column, empty: float) -> Column:
    return F.when(F.coalesce(den, F.lit(0)) == 0, F.lit(empty)).otherwise(num.cast("double") / den)


def health_report(runs: DataFrame, null_cols: dict[str, str]) -> DataFrame:
    """One row a source over its last active runs. null_cols: field -> column of its null rate. Blocked runs
    take a place in the window and are then left out."""
    win = recent(runs, canary=False)
    c = win.withColumn("ok_run", F.col("outcome") != "blocked")
    c = c.withColumn("crn", F.when(F.col("ok_run"), F.row_number().over(Window.partitionBy("source_id", "ok_run").orderBy(F.col("id").desc()))))
    own = lambda x: F.when(F.col("ok_run"), x)
    aggs = [
        F.count(F.when(F.col("ok_run"), 1)).alias("considered"),
        F.count(F.when(~F.col("ok_run"), 1)).alias("blocked"),
        F.sum(own(F.col("items"))).alias("ti"),
        F.sum(own(F.col("valid_items"))).alias("tv"),
        F.max(F.when(F.col("crn") == 1, F.col("items"))).alias("latest"),
        F.median(F.when(F.col("crn") > 1, F.col("items"))).alias("med"),
        F.count(F.when(F.col("crn") > 1, 1)).alias("ntrail"),
        F.min(F.when(~F.col("outcome").isin(*FAILURES), F.col("crn"))).alias("first_good"),
    ]
    for f, col in null_cols.items():
        counted = F.col("ok_run") & F.col(col).isNotNull() & (F.col("items") > 0)
        aggs += [F.sum(F.when(counted, F.col(col) * F.col("items"))).alias(f"wn_{f}"), F.sum(F.when(counted, F.col("items"))).alias(f"wt_{f}")]
    a = c.groupBy("source_id").agg(*aggs)
    invalid = _rate(F.col("ti") - F.col("tv"), F.col("ti"), 0.0)
    nulls = {f: _rate(F.col(f"wn_{f}"), F.col(f"wt_{f}"), 0.0) for f in null_cols}
    streak = F.coalesce(F.col("first_good"), F.col("considered") + 1) - 1
    trip_null = F.lit(False)
    for r in nulls.values():
        trip_null |= r > MAX_NULL_RATE
    return a.select(
        "source_id",
        "considered",
        "blocked",
        F.round(invalid, 6).alias("schema_invalid_rate"),
        F.coalesce("latest", F.lit(0)).cast("long").alias("latest_items"),
        F.coalesce("med", F.lit(0.0)).cast("double").alias("median_items"),
        streak.cast("long").alias("streak"),
        *[F.round(r, 6).alias(f"null_rate_{f}") for f, r in nulls.items()],
        (invalid > MAX_INVALID_RATE).alias("trip_schema"),
        trip_null.alias("trip_null"),
        F.coalesce((F.col("ntrail") >= 2) & (F.col("med") > 0) & (F.col("latest") < YIELD_FACTOR * F.col("med")), F.lit(False)).alias("trip_yield"),
        (streak >= STREAK).alias("trip_streak"),
    )


def report_of(ring: Column, null_cols: dict[str, str]) -> list[Column]:
    """The columns of health_report, without the source, from an array of a source's last active runs, newest first
    (outcome, items, valid_items and the null rates): the same rules, as expressions over at most WINDOW elements."""
    own = F.filter(ring, lambda r: r["outcome"] != "blocked")

    def let(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def figures(runs: Column) -> Column:
        total = lambda f: F.aggregate(F.transform(runs, f), F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
        counts = F.array_sort(F.transform(F.slice(runs, 2, WINDOW), lambda r: r["items"]))
        n = F.size(runs) - 1
        middle = lambda c: F.when(n > 0, (F.get(c, F.expr("0") + F.floor((n - 1) / 2).cast("int")) + F.get(c, F.floor(n / 2).cast("int"))) / 2.0)
        good = F.transform(runs, lambda r: ~r["outcome"].isin(*FAILURES))
        first = F.array_position(good, True)
        nulls = [F.struct(total(lambda r: F.when(r[c].isNotNull() & (r["items"] > 0), r[c] * r["items"])).alias("num"), total(lambda r: F.when(r[c].isNotNull() & (r["items"] > 0), r["items"])).alias("den")).alias(f) for f, c in null_cols.items()]  # noqa: B023
        return F.struct(
            F.size(runs).cast("long").alias("considered"), total(lambda r: r["items"]).alias("ti"), total(lambda r: r["valid_items"]).alias("tv"), F.get(runs, F.lit(0))["items"].alias("latest"),
            let(counts, middle).alias("med"), F.greatest(n, F.lit(0)).alias("ntrail"), F.when(first == 0, F.size(runs)).otherwise(first - 1).alias("streak"), *nulls,
        )

    def verdict(x: Column) -> Column:
        invalid = _rate(x["ti"] - x["tv"], x["ti"], 0.0)
        nulls = {f: _rate(x[f]["num"], x[f]["den"], 0.0) for f in null_cols}
        trip_null = F.lit(False)
        for r in nulls.values():
            trip_null |= r > MAX_NULL_RATE
        return F.struct(
            x["considered"].alias("considered"), (F.size(ring) - x["considered"]).cast("long").alias("blocked"), F.round(invalid, 6).alias("schema_invalid_rate"), F.coalesce(x["latest"], F.lit(0)).cast("long").alias("latest_items"),
            F.coalesce(x["med"], F.lit(0.0)).cast("double").alias("median_items"), x["streak"].cast("long").alias("streak"), *[F.round(r, 6).alias(f"null_rate_{f}") for f, r in nulls.items()], (invalid > MAX_INVALID_RATE).alias("trip_schema"), trip_null.alias("trip_null"),
            F.coalesce((x["ntrail"] >= 2) & (x["med"] > 0) & (x["latest"] < YIELD_FACTOR * x["med"]), F.lit(False)).alias("trip_yield"), (x["streak"] >= STREAK).alias("trip_streak"),
        )

    names = ["considered", "blocked", "schema_invalid_rate", "latest_items", "median_items", "streak", *[f"null_rate_{f}" for f in null_cols], "trip_schema", "trip_null", "trip_yield", "trip_streak"]
    out = let(let(own, figures), verdict)
    return [out[n].alias(n) for n in names]


def health_after_each(runs: DataFrame, null_cols: dict[str, str], split: int = SPLIT) -> DataFrame:
    """For every active run, what health_report says of its source once that run is there: id, source_id, the report.
    Where a source has more than split runs, all are dealt by ranges, as in rolling_yield."""
    r = runs.where("not canary").select("id", "source_id", F.struct("outcome", "items", "valid_items", *null_cols.values()).alias("items"))
    if busiest(r, "source_id") > split:
        r = _last_items(r, WINDOW - 1)
    else:
        r = r.withColumn("last", F.collect_list("items").over(Window.partitionBy("source_id").orderBy("id").rowsBetween(-(WINDOW - 1), -1)))
    r = r.withColumn("ring", F.concat(F.array("items"), F.reverse("last")))
    return r.select("id", "source_id", *report_of(F.col("ring"), null_cols))


def degraded() -> Column:
    return F.col("trip_schema") | F.col("trip_null") | F.col("trip_yield") | F.col("trip_streak")


def _last_items(r: DataFrame, back: int) -> DataFrame:
    """r (id, source_id, items) with last: the items of up to back rows before in the source, dealt by ranges of
    source and id. What a range needs of those before it lies in back ranges of the source at most."""
    r = ranged(r, ["source_id", "id"])
    w = Window.partitionBy("__part", "source_id").orderBy("id")
    r = r.withColumn("own", F.collect_list("items").over(w.rowsBetween(-back, -1)))
    newest = r.withColumn("k", F.row_number().over(Window.partitionBy("__part", "source_id").orderBy(F.col("id").desc()))).where(F.col("k") <= back)
    tails = newest.groupBy("source_id", "__part").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "items"))), lambda x: x["items"]).alias("tail"))
    earlier = Window.partitionBy("source_id").orderBy("__part").rowsBetween(-back, -1)
    ahead = tails.select("source_id", "__part", F.flatten(F.collect_list("tail").over(earlier)).alias("ahead"))
    want = F.least(F.lit(back) - F.size("own"), F.size("ahead"))
    return r.join(ahead, ["source_id", "__part"]).withColumn("last", F.concat(F.slice("ahead", F.size("ahead") - want + 1, want), F.col("own")))


def rolling_yield(runs: DataFrame, span: int = WINDOW, split: int = SPLIT) -> DataFrame:
    """For every run that is not blocked: the median of the items of up to span - 1 runs before it, and whether
    the run falls under the yield rule. Where a source has more than split runs, all are dealt by ranges of source
    and id, so that it is spread over many tasks; the result is the same."""
    r = runs.where("outcome <> 'blocked' and not canary").select("id", "source_id", "items")
    if busiest(r, "source_id") > split:
        r = _last_items(r, span - 1)
    else:
        r = r.withColumn("last", F.collect_list("items").over(Window.partitionBy("source_id").orderBy("id").rowsBetween(-(span - 1), -1)))
    # Spark has no framed median; the frame is at most span - 1 numbers.
    r = r.withColumn("last", F.sort_array("last")).withColumn("n", F.size("last"))
    r = r.withColumn("trailing", (F.get("last", F.expr("(n - 1) div 2")) + F.get("last", F.expr("n div 2"))) / 2.0)
    low = (F.col("n") >= 2) & (F.col("trailing") > 0) & (F.col("items") < YIELD_FACTOR * F.col("trailing"))
    return r.select("id", "source_id", "items", F.coalesce("trailing", F.lit(0.0)).cast("double").alias("trailing_median"), F.coalesce(low, F.lit(False)).alias("collapsed"))


def canary_verdict(runs: DataFrame) -> DataFrame:
    """Promote, reject or wait, by one conditional aggregate over both arms' last runs."""
    w = Window.partitionBy("source_id", "canary").orderBy(F.col("id").desc())
    r = runs.withColumn("rn", F.row_number().over(w)).where((F.col("rn") <= CANARY_WINDOW) & (F.col("outcome") != "blocked"))
    arm = lambda x, c: F.sum(F.when(F.col("canary") == c, x))
    a = r.groupBy("source_id").agg(
        *[F.coalesce(arm(v, c), F.lit(0)).cast("long").alias(f"{n}{k}") for k, c in (("c", True), ("a", False)) for n, v in (("runs_", F.lit(1)), ("items_", F.col("items")), ("valid_", F.col("valid_items")))]
    )
    bad = {k: _rate(F.col(f"items_{k}") - F.col(f"valid_{k}"), F.col(f"items_{k}"), 1.0) for k in "ca"}
    mean = {k: _rate(F.col(f"items_{k}"), F.col(f"runs_{k}"), 0.0) for k in "ca"}
    verdict = F.when(F.col("runs_c") < CANARY_RUNS, "wait").when(bad["c"] > bad["a"], "reject").when((mean["a"] > 0) & (mean["c"] < CANARY_YIELD * mean["a"]), "reject").otherwise("promote")
    reason = F.when(F.col("runs_c") < CANARY_RUNS, "runs").when(bad["c"] > bad["a"], "invalid_rate").when((mean["a"] > 0) & (mean["c"] < CANARY_YIELD * mean["a"]), "yield")
    return a.select("source_id", F.col("runs_c").alias("canary_runs"), *[F.round(bad[k], 6).alias(f"{n}_invalid_rate") for k, n in (("c", "canary"), ("a", "active"))], *[F.round(mean[k], 6).alias(f"{n}_yield") for k, n in (("c", "canary"), ("a", "active"))], verdict.alias("verdict"), reason.alias("reason"))


def failed_repairs(compile_runs: DataFrame) -> DataFrame:
    return compile_runs.where("kind = 'repair' and state = 'failed'").groupBy("source_id").agg(F.count("*").alias("failed"))


def health_action(report: DataFrame, sources: DataFrame, compile_runs: DataFrame) -> DataFrame:
    """What to do about each source: none, degrade and queue a repair, or disable."""
    open_runs = compile_runs.where("state in ('queued', 'running')").select("source_id").distinct().withColumn("is_open", F.lit(True))
    j = report.join(sources.select("source_id", "state"), "source_id").join(failed_repairs(compile_runs), "source_id", "left").join(open_runs, "source_id", "left")
    failed = F.coalesce("failed", F.lit(0))
    action = F.when(~degraded() | (F.col("state") != "active"), "none").when(failed >= MAX_FAILED_REPAIRS, "disabled").otherwise("degraded")
    j = j.withColumn("action", action)
    return j.select("source_id", "state", "action", F.when(F.col("action") == "none", F.col("state")).otherwise(F.col("action")).alias("next_state"), ((F.col("action") == "degraded") & F.col("is_open").isNull()).alias("queues_repair"), failed.cast("long").alias("failed_repairs"))


def run_summary(runs: DataFrame) -> DataFrame:
    """One row over a batch of runs."""
    bad = ~F.col("outcome").isin("ok", "schema_invalid")
    return runs.agg(F.count("*").alias("runs"), F.coalesce(F.sum("items"), F.lit(0)).cast("long").alias("items"), F.coalesce(F.sum("valid_items"), F.lit(0)).cast("long").alias("valid_items"), F.count(F.when(bad, 1)).alias("failed"), F.coalesce(F.bool_and(bad), F.lit(False)).alias("all_failed"))
