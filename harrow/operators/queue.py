"""Scheduling as state transitions: due sources, enqueue, claim, retry, reclaim, politeness, state machine.

A table is claimed by one writer that ranks the rows that are due; there are no row locks.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import written
from .tables import ERROR_CHARS, SPLIT, busiest, ranged, sequenced

MAX_ATTEMPTS = 5
LEASE_S = 900
MIN_GAP_MS = 1000
#: What one page of due sources, one drain of jobs and one of compile runs take at most.
DUE_PAGE = 50
MAX_JOBS = 500
MAX_COMPILES = 20
#: Source states by event, as fixed values: (state, event) -> state; a dash stands for any state.
FSM = [
    ("-", "claim_compile", "compiling"),
    ("-", "claim_repair", "repairing"),
    ("-", "compile_ok", "active"),
    ("-", "repair_ok", "active"),
    ("-", "compile_failed", "new"),
    ("-", "repair_failed", "degraded"),
    ("active", "degrade", "degraded"),
    ("active", "disable", "disabled"),
    ("-", "canary_promoted", "active"),
]


def ntz(t: datetime) -> Column:
    return F.lit(t).cast("timestamp_ntz")


#: Units of an interval's text and what they count as: months, days or seconds.
UNITS = {"mill(?:ennium|ennia|s?)": ("months", 12000), "cent(?:ury|uries|s?)": ("months", 1200), "dec(?:ade)?s?": ("months", 120), "y(?:(?:ea)?rs?)?": ("months", 12), "mons?|months?": ("months", 1), "w(?:eeks?)?": ("days", 7), "d(?:ays?)?": ("days", 1), "h(?:ours?|rs?)?": ("seconds", 3600), "m(?:in(?:ute)?s?)?": ("seconds", 60), "s(?:ec(?:ond)?s?)?": ("seconds", 1)}


def interval_parts(text: Column) -> Column:
    """A span of time as text (``1 mon 2 days``, ``-1 days +01:30:00``, ``36:00:00``, ``2 weeks ago``) as months, days and
    seconds; null where it is none. They stay apart, as a month has no fixed length in days."""
    t = F.lower(F.trim(text))
    clock = r"([+-]?)(\d+):(\d{1,2})(?::(\d{1,2}(?:\.\d+)?))?"
    number = r"[+-]?\d+(?:\.\d+)?"
    known = "|".join(UNITS)
    good = t.rlike(rf"^(?:@\s*)?(?:(?:{number}\s*(?:{known})|{clock})(?:\s+|(?=[+-])|$))+(?:ago)?$")

    def total(of: str) -> Column:
        parts = []
        for unit, (kind, size) in UNITS.items():
            if kind == of:
                found = F.regexp_extract_all(t, F.lit(rf"({number})\s*(?:{unit})(?![a-z])"), F.lit(1))
                parts.append(F.aggregate(F.transform(found, lambda x: x.cast("decimal(20,6)")), F.lit(0).cast("decimal(20,6)"), lambda x, y: (x + y).cast("decimal(20,6)")) * size)
        out = parts[0]
        for x in parts[1:]:
            out = out + x
        return out

    piece = lambda k: F.coalesce(F.nullif(F.regexp_extract(t, clock, k), F.lit("")).cast("decimal(20,6)"), F.lit(0))
    at = (piece(2) * 3600 + piece(3) * 60 + piece(4)) * F.when(F.regexp_extract(t, clock, 1) == "-", -1).otherwise(1)
    sign = F.when(F.endswith(t, F.lit("ago")), -1).otherwise(1)
    return F.when(good, F.struct((total("months") * sign).cast("int").alias("months"), (total("days") * sign).cast("int").alias("days"), ((total("seconds") + at) * sign).cast("decimal(18,6)").alias("seconds")))


def before(at: Column, parts: Column) -> Column:
    """at less a span: months first, as the calendar has them, then days, then time."""
    zero = F.lit(0)
    return at - F.make_interval(zero, parts["months"], zero, parts["days"], zero, zero, parts["seconds"])


def due_sources(sources: DataFrame, runs: DataFrame, as_of: datetime, limit: int | None = None) -> DataFrame:
    """Scheduled sources without a run inside their cadence (a column cadence of text, or cadence_days): their newest
    run, one row a source before anything is shuffled, is not younger than that.
    With a limit, so many of those that have waited longest (updated_at)."""
    s = sources.where(F.col("state").isin("active", "repairing"))
    newest = runs.groupBy(F.col("source_id").alias("run_source")).agg(F.max("created_at").alias("newest"))
    since = before(ntz(as_of), interval_parts(F.col("cadence"))) if "cadence" in sources.columns else ntz(as_of) - F.make_dt_interval(F.col("cadence_days"))
    j = s.join(newest, F.col("source_id") == F.col("run_source"), "left")
    due = j.where(F.col("newest").isNull() | (F.col("newest") <= since)).select(*sources.columns)
    return due if limit is None else due.orderBy("updated_at", "source_id").limit(limit)


def encode_component(c: Column) -> Column:
    """Percent-encoding of a URL component: blanks as %20, and !'()* as they are."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def resolve_url(template: Column, key: Column) -> Column:
    return F.replace(template, F.lit("{key}"), encode_component(key))


def tick(due: DataFrame, with_adapter: DataFrame) -> DataFrame:
    """One job per due source and entry key, or why there is none. due: source_key, template, entry_keys (array);
    with_adapter: source_ids that an adapter can run."""
    j = due.join(with_adapter.select("source_id").distinct().withColumn("has_adapter", F.lit(True)), "source_id", "left")
    keyed = F.contains(F.col("template"), F.lit("{key}"))
    none = F.size(F.coalesce("entry_keys", F.array().cast("array<string>"))) == 0
    status = F.when(F.col("has_adapter").isNull(), "skipped").when(F.col("template").isNull() | (keyed & none), "misconfigured").otherwise("queued")
    j = j.withColumn("status", status).withColumn("key", F.explode(F.when((F.col("status") == "queued") & ~none, F.col("entry_keys")).otherwise(F.array("source_key"))))
    return j.select("source_id", "key", "status", F.when(F.col("status") == "queued", resolve_url(F.col("template"), F.col("key"))).alias("url"))


JOB_KEY = ["source_id", "url"]


def enqueue(jobs: DataFrame, requests: DataFrame, as_of: datetime) -> DataFrame:
    """jobs after requests (JOB_KEY, external_key, priority, run_after, pos), with the effect on each: what runs is
    left alone, anything else under the same key starts over with the request's priority and time, new keys are
    added, with ids counted on in the order of their keys. Of requests for one key, taken in the order of pos, the
    last one's priority and time hold, and the first one's external key. Without a time a job may run at once."""
    r = requests.groupBy(*JOB_KEY).agg(F.min_by("external_key", "pos").alias("new_key"), F.max_by(F.struct(F.coalesce("priority", F.lit(100)).alias("priority"), F.coalesce("run_after", ntz(as_of)).alias("run_after")), "pos").alias("new"))
    j = jobs.join(r, JOB_KEY, "full_outer")
    asked, there = F.col("new").isNotNull(), F.col("id").isNotNull()
    reset = asked & ~F.col("state").eqNullSafe("running")
    j = j.select(
        "id",
        *JOB_KEY,
        F.when(there, F.col("external_key")).otherwise(F.col("new_key")).alias("external_key"),
        F.when(reset, F.col("new.priority")).otherwise(F.col("priority")).alias("priority"),
        F.when(reset, "queued").otherwise(F.col("state")).alias("state"),
        F.when(reset, 0).otherwise(F.col("attempts")).alias("attempts"),
        F.when(reset, F.col("new.run_after")).otherwise(F.col("run_after")).alias("run_after"),
        F.when(~reset, F.col("locked_by")).alias("locked_by"),
        F.when(~reset, F.col("locked_at")).alias("locked_at"),
        F.col("last_error"),
        F.when(~asked, "kept").when(~there, "inserted").when(reset, "reset").otherwise("running").alias("effect"),
    )
    j = written(j, "enqueue")
    last = j.agg(F.max("id").alias("id")).first()["id"] or 0
    return j.where("id is not null").unionByName(sequenced(j.where("id is null").drop("id"), JOB_KEY, last).select(j.columns))


def claim(jobs: DataFrame, workers: int, as_of: datetime) -> DataFrame:
    """The jobs that so many workers get: the first by priority and id of those due. A global top-k, ranked after
    the limit has cut it down."""
    first = jobs.where((F.col("state") == "queued") & (F.col("run_after") <= ntz(as_of))).orderBy("priority", "id").limit(workers)
    n = F.row_number().over(Window.orderBy("priority", "id"))
    return first.select("id", "source_id", "priority", n.alias("worker"), (F.col("attempts") + 1).cast("int").alias("attempts"), F.lit("running").alias("state"), F.concat(F.lit("worker-"), n.cast("string")).alias("locked_by"), ntz(as_of).alias("locked_at"))


def drain(jobs: DataFrame, as_of: datetime, most: int = MAX_JOBS) -> DataFrame:
    """What one drain runs: the jobs due, in the order of their claims, most at the most."""
    return claim(jobs, most, as_of)


def claim_each(rows: DataFrame, key: str = "source_id") -> DataFrame:
    """The oldest queued row of every key without a running one."""
    busy = rows.where("state = 'running'").select(key).distinct()
    return rows.where("state = 'queued'").join(busy, key, "left_anti").groupBy(key).agg(F.min("id").alias("id"), F.count("*").alias("waiting"))


def backoff_s(attempts: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), attempts) * 30, F.lit(3600.0)).cast("int")


def fail(jobs: DataFrame, as_of: datetime, error: Column | None = None) -> DataFrame:
    """Failed jobs: queued again after a backoff, or dead after MAX_ATTEMPTS; unlocked, with the error, cut."""
    error = F.substring(F.lit(None).cast("string") if error is None else error, 1, ERROR_CHARS["job"])
    dead = F.col("attempts") >= MAX_ATTEMPTS
    wait = F.when(dead, 0).otherwise(backoff_s(F.col("attempts")))
    return jobs.select("id", "source_id", "attempts", F.when(dead, "dead").otherwise("queued").alias("state"), wait.cast("int").alias("backoff_s"), (ntz(as_of) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait.cast("decimal(18,6)"))).alias("run_after"), error.alias("last_error"), F.lit(None).cast("string").alias("locked_by"), F.lit(None).cast("timestamp_ntz").alias("locked_at"))


def reclaim(jobs: DataFrame, as_of: datetime, lease_s: int = LEASE_S) -> DataFrame:
    """Running jobs whose lease has run out, queued again with their attempts kept."""
    stale = (F.col("state") == "running") & (F.col("locked_at") < ntz(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lease_s).cast("decimal(18,6)")))
    return jobs.where(stale).select("id", "source_id", "attempts", F.lit("queued").alias("state"), F.lit(None).cast("string").alias("locked_by"), F.lit(None).cast("timestamp_ntz").alias("locked_at"))


def depth(jobs: DataFrame) -> DataFrame:
    return jobs.where("state = 'queued'").groupBy("source_id").agg(F.count("*").alias("depth"))


def route(job_id: Column, active: Column, canary: Column, share: float = 0.1) -> Column:
    """The adapter a job runs: a canary next to an active one gets its share of job ids."""
    return F.when(active.isNotNull() & canary.isNotNull(), F.when(F.pmod(job_id, F.lit(100)) < round(share * 100), canary).otherwise(active)).otherwise(F.coalesce(active, canary))


def queue_repairs(compile_runs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (source_id, kind) that start a compile run: at most one open run a source."""
    held = compile_runs.where("state in ('queued', 'running')").select("source_id").distinct()
    return requests.join(held, "source_id", "left_anti").groupBy("source_id").agg(F.min("kind").alias("kind"), F.lit("queued").alias("state"))


def polite(requests: DataFrame, gap_ms: int = MIN_GAP_MS, split: int = SPLIT) -> DataFrame:
    """start_ms of each request (host, at_ms, id): at least gap_ms after the one before it on its host. As a
    running maximum: start_i = gap * i + max over j <= i of (at_j - gap * j). Without a host there is no gap.

    Where a host has more than split requests, all are dealt by ranges of host and time, so that it is spread over
    many tasks: each counts and takes its maximum for itself, and a table of one row a range and host says what came
    before. The result is the same."""
    asked = requests.where(F.col("host").isNotNull())
    if busiest(asked, "host") > split:
        out = _polite_ranges(asked, gap_ms)
    else:
        w = Window.partitionBy("host").orderBy("at_ms", "id")
        numbered = asked.withColumn("__i", F.row_number().over(w))
        out = numbered.withColumn("start_ms", gap_ms * F.col("__i") + F.max(F.col("at_ms") - gap_ms * F.col("__i")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__i")
    free = requests.where(F.col("host").isNull()).withColumn("start_ms", F.col("at_ms"))
    return out.unionByName(free).withColumn("start_ms", F.col("start_ms").cast("long")).withColumn("waited_ms", F.col("start_ms") - F.col("at_ms"))


def _polite_ranges(asked: DataFrame, gap_ms: int) -> DataFrame:
    """asked with start_ms, by ranges."""
    r = ranged(asked, ["host", "at_ms", "id"])
    w = Window.partitionBy("__part", "host").orderBy("at_ms", "id")
    own = r.withColumn("__i", F.row_number().over(w)).withColumn("__lead", F.max(F.col("at_ms") - gap_ms * F.col("__i")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = own.groupBy("host", "__part").agg(F.count("*").alias("n"), F.max("__lead").alias("lead"))
    earlier = Window.partitionBy("host").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("__most", F.max(F.col("lead") - gap_ms * F.col("__before")).over(earlier)).drop("n", "lead")
    lead = F.greatest("__most", F.col("__lead") - gap_ms * F.col("__before"))
    return own.join(blocks, ["host", "__part"]).withColumn("start_ms", gap_ms * (F.col("__before") + F.col("__i")) + lead).select(*asked.columns, "start_ms")


def next_state(state: Column, event: Column) -> Column:
    """The state machine of sources; an event that does not apply leaves the state."""
    out = state
    for old, what, new in reversed(FSM):
        out = F.when((event == what) & (F.lit(True) if old == "-" else state == old), new).otherwise(out)
    return out
