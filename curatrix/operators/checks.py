"""Link checks: queues, verdict counts, reasons, pruning behind a safety ratio, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions import status as S
from curatrix.functions.dates import at, days_since

RETENTION_DAYS, MAX_PRUNE_PCT, BREAKER_PCT, VERIFY_LIMIT = 90, 10, 40, 300
REASONS = ["gone", "unreachable", "stale"]


def verify_queue(artifacts: DataFrame, checks: DataFrame, limit: int = VERIFY_LIMIT, key: str = "artifact_id") -> DataFrame:
    """The records checked longest ago, never checked ones first."""
    last = checks.groupBy(key).agg(F.max("checked_at").alias("last_checked"))
    return artifacts.join(last, key, "left").orderBy(F.col("last_checked").asc_nulls_first(), key).limit(limit)


def latest_check(checks: DataFrame, key: str = "artifact_id") -> DataFrame:
    """The last observation of each record (one aggregation, no sort)."""
    last = F.max(F.struct("checked_at", "id", "http_status"))
    return checks.groupBy(key).agg(last.alias("_l")).select(key, F.col("_l.checked_at").alias("checked_at"), F.col("_l.id").alias("id"), F.col("_l.http_status").alias("http_status"))


def trailing_runs(checks: DataFrame, key: str = "artifact_id") -> DataFrame:
    """For each record: any terminal check, and the number of separate days with transient checks since the last ok.

    The last ok is an aggregate, so no record's history is sorted in one task.
    """
    v = checks.withColumn("_v", S.verdict(F.col("http_status"))).withColumn("_o", F.struct("checked_at", "id"))
    marks = v.groupBy(key).agg(F.max(F.col("_v") == "terminal").alias("terminal"), F.max(F.when(F.col("_v") == "ok", F.col("_o"))).alias("_ok"))
    days = v.filter(F.col("_v") == "transient").groupBy(key, F.to_date("checked_at").alias("_day")).agg(F.max("_o").alias("_last"))
    run = days.join(marks.select(key, "_ok"), key).filter(F.col("_ok").isNull() | (F.col("_last") > F.col("_ok"))).groupBy(key).agg(F.count(F.lit(1)).alias("run"))
    return marks.join(run, key, "left").select(key, "terminal", F.coalesce("run", F.lit(0)).alias("run"))


def inactive_reasons(checks: DataFrame, last_seen: DataFrame, now: str, key: str = "artifact_id") -> DataFrame:
    """(key, terminal, run, days_old, reason); null for records to keep."""
    joined = last_seen.join(trailing_runs(checks, key), key, "left")
    terminal, run = F.coalesce("terminal", F.lit(False)), F.coalesce("run", F.lit(0))
    days = days_since(F.col("last_seen_at"), now)
    return joined.select(key, terminal.alias("terminal"), run.alias("run"), days.alias("days_old"), S.inactive_reason(terminal, run, days).alias("reason"))


def prune_candidates(checks: DataFrame, active: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Counting mode: any terminal check or at least three transient ones, whenever they were."""
    counts = checks.join(active.select(key), key).groupBy(key).agg(
        F.count_if(F.col("http_status").isin(S.TERMINAL)).alias("terminal"),
        F.count_if(F.col("http_status").isin(S.TRANSIENT)).alias("transient"),
        F.max_by("http_status", F.struct("checked_at", "id")).alias("last_status"),
    )
    return counts.filter((F.col("terminal") >= 1) | (F.col("transient") >= S.UNREACHABLE_RUN))


def safety_ratio(candidates: DataFrame, live: DataFrame, limit: int = MAX_PRUNE_PCT, rounded: bool = False) -> DataFrame:
    """(candidates, live, ratio_pct, blocked). No live record is no block."""
    c = candidates.agg(F.count(F.lit(1)).alias("candidates"))
    n = live.agg(F.count(F.lit(1)).alias("live"))
    pct = F.when(F.col("live") > 0, 100 * F.col("candidates") / F.col("live")).otherwise(F.lit(0.0))
    shown = F.round(pct, 0)
    return c.join(n, F.lit(True)).select("candidates", "live", shown.cast("long").alias("ratio_pct"), ((shown if rounded else pct) > limit).alias("blocked"))


def decisions(reasons: DataFrame, live: DataFrame, limit: int = MAX_PRUNE_PCT, dry_run: bool = True) -> DataFrame:
    """Records to retire with their reason; none is marked when the ratio blocks or in a dry run, which is the default."""
    found = reasons.filter(F.col("reason").isNotNull())
    gate = safety_ratio(found, live, limit).select("blocked")
    return found.join(F.broadcast(gate), F.lit(True)).withColumn("deactivate", ~F.col("blocked") & F.lit(not dry_run))


def sentinel(due: DataFrame, live: DataFrame, now: str, limit: int = MAX_PRUNE_PCT) -> tuple[DataFrame, DataFrame]:
    """(appended, report) of one run over the observations that are due (artifact_id, http_status).

    Every bad observation is appended again, as of now; the report counts all, and says whether the terminal ones are
    too many of the live records for a prune.
    """
    seen = due.withColumn("_v", S.verdict(F.col("http_status")))
    appended = seen.filter("_v <> 'ok'").select("artifact_id", at(now).alias("checked_at"), "http_status", F.lit(False).alias("ok"))
    count = lambda v: F.count_if(F.col("_v") == v)
    n = live.agg(F.count(F.lit(1)).alias("live"))
    tally = seen.agg(F.count(F.lit(1)).alias("checked"), count("ok").alias("ok"), (count("terminal") + count("transient")).alias("failed"), count("terminal").alias("_t"))
    blocked = F.when(F.col("live") > 0, 100 * F.col("_t") > limit * F.col("live")).otherwise(False)
    return appended, tally.join(n, F.lit(True)).select("checked", "ok", "failed", blocked.alias("blocked"))


def by_reason(reasons: DataFrame) -> DataFrame:
    """Histogram with a row for each reason, also without records."""
    known = reasons.sparkSession.createDataFrame([(r,) for r in REASONS], "reason string")
    counts = reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(known).join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def trim(checks: DataFrame, now: str, days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted) observations."""
    old = F.col("checked_at").cast("timestamp") < at(now) - F.expr(f"INTERVAL {days} DAYS")
    return checks.filter(~old | F.col("checked_at").isNull()), checks.filter(old)


def verdict_tally(checks: DataFrame, *by: str) -> DataFrame:
    v = S.verdict(F.col("http_status"))
    return checks.groupBy(*by, v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def circuit_breaker(checks: DataFrame, *by: str, limit: int = BREAKER_PCT) -> DataFrame:
    failed = F.count_if(S.verdict(F.col("http_status")) != "ok")
    return checks.groupBy(*by).agg(F.count(F.lit(1)).alias("checked"), failed.alias("failed")).withColumn("tripped", 100 * F.col("failed") > limit * F.col("checked"))


def failure_runs(runs: DataFrame, key: str = "source_id") -> DataFrame:
    """Consecutive failures of each source since its last run that did not fail, and its health."""
    o = F.struct("started_at", "id")
    marks = runs.groupBy(key).agg(F.max(F.when(F.col("status") != "failed", o)).alias("_ok"), F.max("started_at").alias("last_run_at"))
    run = runs.filter("status = 'failed'").join(marks.select(key, "_ok"), key).filter(F.col("_ok").isNull() | (o > F.col("_ok"))).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    health = F.when(n == 0, "healthy").when(n < S.UNREACHABLE_RUN, "degraded").otherwise("failing")
    return marks.join(run, key, "left").select(key, "last_run_at", n.alias("consecutive_failures"), health.alias("health"))
