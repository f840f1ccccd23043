"""Read side: filters, listings, pages, queues and counts. Every ordered cut ends in the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.dates import at

PAGE_SIZE, MAX_PAGE_SIZE = 24, 100


def active(rows: DataFrame) -> DataFrame:
    return rows.filter("is_active")


def of_kinds(rows: DataFrame, *kinds: str) -> DataFrame:
    return active(rows).filter(F.col("kind").isin(list(kinds)))


def by_url(rows: DataFrame, url: str) -> DataFrame:
    return rows.filter(F.col("source_url") == url).limit(1)


def top(rows: DataFrame, kind: str | None = None, limit: int = PAGE_SIZE, offset: int = 0) -> DataFrame:
    rows = active(rows) if kind is None else of_kinds(rows, kind)
    return rows.orderBy(F.desc("quality_score"), "id").offset(max(offset, 0)).limit(max(limit, 0))


def clamp_limit(limit: Column) -> Column:
    return F.when(limit.isNull() | (limit <= 0), PAGE_SIZE).otherwise(F.least(limit, F.lit(MAX_PAGE_SIZE))).cast("int")


def clamp_page(page: Column) -> Column:
    return F.greatest(F.coalesce(page, F.lit(1)), F.lit(1)).cast("int")


def page(rows: DataFrame, kind: str | None, number: int = 1, limit: int | None = None) -> DataFrame:
    number, size = max(number, 1), min(limit or PAGE_SIZE, MAX_PAGE_SIZE)
    return top(rows, kind, size, (number - 1) * size)


def page_meta(rows: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """Per kind: total, pages, and whether there is a page before and behind ``number``."""
    n = active(rows).groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    return n.withColumn("pages", F.ceil(F.col("total") / size)).withColumn("has_next", F.col("pages") > number).withColumn("has_prev", F.lit(number > 1))


def recent(rows: DataFrame, limit: int = 8) -> DataFrame:
    return active(rows).orderBy(F.desc("last_seen_at"), "id").limit(limit)


def enrich_queue(rows: DataFrame, limit: int = 100) -> DataFrame:
    return active(rows).filter(F.col("enriched_at").isNull()).orderBy(F.desc("last_seen_at"), "id").limit(limit)


def stale_queue(rows: DataFrame, limit: int = 100, force: bool = False) -> DataFrame:
    """The queue as documented: never enriched, or not since the record was last seen; with ``force``, every active record."""
    due = F.lit(force) | F.col("enriched_at").isNull() | F.coalesce(F.col("enriched_at") < F.col("last_seen_at"), F.lit(False))
    return active(rows).filter(due).orderBy(F.col("enriched_at").asc_nulls_first(), "id").limit(limit)


def count_by_kind(rows: DataFrame) -> DataFrame:
    return active(rows).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def is_due(last_run: Column, cadence_hours: Column, now: str) -> Column:
    return last_run.isNull() | (last_run.cast("timestamp") + F.make_interval(hours=cadence_hours) <= at(now))


def due_sources(sources: DataFrame, now: str, limit: int = 100) -> DataFrame:
    due = sources.filter(F.col("enabled") & is_due(F.col("last_run_at"), F.col("cadence_hours"), now))
    return due.orderBy(F.col("last_run_at").asc_nulls_first(), "id").limit(max(1, limit))


def stamp(sources: DataFrame, selected: DataFrame, now: str) -> DataFrame:
    """``sources`` with the selected ones' last run set to now."""
    hit = selected.select("id", F.lit(True).alias("_hit"))
    return sources.join(hit, "id", "left").withColumn("last_run_at", F.when(F.col("_hit"), at(now)).otherwise(F.col("last_run_at").cast("timestamp"))).drop("_hit")


def lock_decisions(requests: DataFrame, locks: DataFrame, now: str, ttl_seconds: int = 1200, pos: str = "pos") -> DataFrame:
    """Who gets a lock now: the first request for a free or expired one, and nobody after it.

    requests (name, holder, pos: their order), locks (name, holder, expires_at). The others are told who holds the lock.
    """
    held = locks.select("name", F.col("holder").alias("held_by"), F.col("expires_at").cast("timestamp").alias("_until"))
    first = requests.groupBy("name").agg(F.min(F.struct(pos, "holder")).alias("_first"))
    state = first.join(held, "name", "left").withColumn("_free", F.col("_until").isNull() | (F.col("_until") <= at(now)))
    until = F.when(F.col("_free"), at(now) + F.expr(f"INTERVAL {ttl_seconds} SECONDS")).otherwise(F.col("_until"))
    got = F.col("_free") & (F.col(pos) == F.col(f"_first.{pos}")) & (F.col("holder") == F.col("_first.holder"))
    holder = F.when(F.col("_free"), F.col("_first.holder")).otherwise(F.col("held_by"))
    rows = requests.join(state, "name")
    return rows.select("name", "holder", pos, got.alias("acquired"), F.when(~got, holder).alias("blocked_by"), until.alias("expires_at"))


def recount(categories: DataFrame, rows: DataFrame) -> DataFrame:
    """Each category's number of active records, from scratch; also 0."""
    n = active(rows).select(F.explode(F.array_distinct("categories")).alias("slug")).groupBy("slug").agg(F.count(F.lit(1)).alias("n"))
    return categories.join(n, "slug", "left").withColumn("recount", F.coalesce("n", F.lit(0))).drop("n")


def drift(counted: DataFrame) -> DataFrame:
    return counted.agg(F.count_if(F.col("artifact_count") != F.col("recount")).alias("drift_corrected"))


def monthly_rollup(runs: DataFrame, before: str) -> DataFrame:
    """Runs older than ``before`` by source and month."""
    month = F.date_trunc("month", F.col("started_at"))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("ok", "partial", "failed")]
    return runs.filter(F.col("started_at") < F.lit(before).cast("timestamp")).groupBy("source_id", month.alias("month")).agg(F.count(F.lit(1)).alias("runs"), *counts)


def pulse_guards(reports: DataFrame, *by: str, failed_sources: int = 3) -> DataFrame:
    """A pulse fails when nothing was accepted or too many sources failed."""
    n = reports.groupBy(*by).agg(F.sum("accepted").alias("accepted"), F.count_if(F.col("status") == "failed").alias("failed"))
    return n.withColumn("healthy", (F.col("accepted") >= 1) & (F.col("failed") < failed_sources))


def degraded(runs: DataFrame, now: str, hours: int = 48) -> DataFrame:
    last = runs.agg(F.max("finished_at").alias("last_pulse"))
    return last.select("last_pulse", F.coalesce(F.col("last_pulse").cast("timestamp") < at(now) - F.expr(f"INTERVAL {hours} HOURS"), F.lit(True)).alias("degraded"))
