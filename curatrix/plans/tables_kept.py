"""Queries of stored tables: bucketed merges, retention that deletes, rollups. Each makes its table from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from curatrix.buckets import BucketedTable
from curatrix.daylog import DayLog
from curatrix.lineage import shared_dir
from curatrix.operators import upsert
from curatrix.plans import ingest as I
from curatrix.plans import tables as T
from curatrix.schemas import violations
from curatrix.store import Store

TRIM_NOW = "2024-04-10 00:00:00"
ROLLUP_NOW, ROLLUP_DAYS = "2000-08-02 00:00:00", 365


def _store(spark):
    return Store(spark, f"{shared_dir(spark)}/curatrix/tables-{uuid.uuid4().hex}")


def _merged(spark, sf):
    table = BucketedTable(_store(spark), "artifacts", buckets=16)
    table.create(T.stored(spark, sf))
    table.merge(T.batch(spark, sf), I.NOW, I.CONTENT, evidence=lambda done: upsert.report(done, "kind"))
    return table


def merge_buckets(spark, sf):
    """The catalog after a merge that rewrites the buckets of the batch's keys."""
    return I.shown(_merged(spark, sf).read())


def merge_evidence(spark, sf):
    """The run rows that were committed with the merge."""
    return _merged(spark, sf).runs()


def retention_log(spark, sf):
    """What is left by day of the observations after old days were dropped and the boundary's day was split."""
    log = DayLog(_store(spark), "checks")
    log.append(T.checks(spark, sf))
    log.trim(TRIM_NOW)
    return log.read().groupBy(F.date_format("checked_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def rollup_table(spark, sf):
    """Monthly partials that took the place of old run rows, which came in two parts, with the rows that are left by month."""
    log = DayLog(_store(spark), "runs", at="started_at", monthly=True)
    runs = T.runs(spark, sf).withColumn("failed", (F.col("status") == "failed").cast("long"))
    for part in (0, 1):  # the second part's old rows are late: their months have partials by then
        log.append(runs.filter(F.col("id") % 2 == part))
        log.rollup(ROLLUP_NOW, ROLLUP_DAYS, ["source_id"], ["accepted", "failed"])
    left = log.read().groupBy(F.date_format("started_at", "yyyy-MM").alias("month"), "source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("accepted").alias("accepted"), F.sum("failed").alias("failed"))
    said = lambda df, what: df.select("month", "source_id", "n", "accepted", "failed", F.lit(what).alias("kept_as"))
    return said(log.months(), "partial").unionByName(said(left, "rows"))


def append_log(spark, sf):
    """Run rows that were appended in two writes, by status."""
    store, runs = _store(spark), T.runs(spark, sf)
    for part in (0, 1):
        store.append("source_runs", runs.filter(F.col("id") % 2 == part))
    return store.log("source_runs").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("accepted").cast("long").alias("accepted"))


def schema_violations(spark, sf):
    """Rows that break the constraint on the status of runs, where every 50th has a status that is not allowed or none."""
    i = F.col("id")
    broken = F.when(i % 100 == 0, F.lit(None)).when(i % 50 == 0, F.lit("running")).otherwise(F.col("status"))
    return violations(T.runs(spark, sf).withColumn("status", broken), "source_runs")


QUERIES = {f.__name__: f for f in [merge_buckets, merge_evidence, retention_log, rollup_table, append_log, schema_violations]}

ORACLE = {
    "merge_buckets": I.ORACLE["upsert_snapshot"],
    "merge_evidence": I.ORACLE["ingest_report"],
    "retention_log": f"WITH {T.checks_sql()} SELECT strftime(checked_at, '%Y-%m-%d') AS day, count(*) AS n FROM checks WHERE checked_at >= TIMESTAMP '{TRIM_NOW}' - INTERVAL 90 DAY GROUP BY 1",
    "rollup_table": f"""WITH {T.RUNS_SQL} SELECT strftime(started_at, '%Y-%m') AS month, source_id, count(*) AS n, sum(accepted)::BIGINT AS accepted, count(*) FILTER (status = 'failed') AS failed,
      CASE WHEN strftime(started_at, '%Y-%m') < strftime(TIMESTAMP '{ROLLUP_NOW}' - INTERVAL {ROLLUP_DAYS} DAY, '%Y-%m') THEN 'partial' ELSE 'rows' END AS kept_as FROM runs GROUP BY ALL""",
    "append_log": f"WITH {T.RUNS_SQL} SELECT status, count(*) AS n, sum(accepted)::BIGINT AS accepted FROM runs GROUP BY 1",
    "schema_violations": f"WITH {T.RUNS_SQL} SELECT 'status' AS \"constraint\", count(*) FILTER (id % 50 = 0 OR status NOT IN ('ok', 'partial', 'failed')) AS rows FROM runs",
}
