"""Queries of the link checks and of retiring records."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import dates, status
from curatrix.operators import checks as C
from curatrix.plans import tables as T


def classify_status(spark, sf):
    return T.checks(spark, sf).select("id", status.verdict(F.col("http_status")).alias("verdict"))


def verdict_tally(spark, sf):
    return C.verdict_tally(T.checks(spark, sf))


def latest_check(spark, sf):
    return C.latest_check(T.checks(spark, sf)).withColumn("checked_at", dates.iso(F.col("checked_at")))


def _seen(spark, sf):
    return T.last_seen(spark, sf)


def _reasons(spark, sf):
    return C.inactive_reasons(T.checks(spark, sf), _seen(spark, sf), T.ORDERS_NOW)


def inactive_reason(spark, sf):
    return _reasons(spark, sf)


def prune_decisions(spark, sf):
    """Prunes behind the production limit: all reasons, which are too many, and few, which are not; and a dry run."""
    live, found = _seen(spark, sf), _reasons(spark, sf)
    few = found.withColumn("reason", F.when(F.col("artifact_id") % 16 == 0, F.col("reason")))
    runs = {"all": C.decisions(found, live, dry_run=False), "few": C.decisions(few, live, dry_run=False), "dry": C.decisions(few, live)}
    out = None
    for name, d in runs.items():
        d = d.select(F.lit(name).alias("run"), "artifact_id", "reason", "deactivate")
        out = d if out is None else out.unionByName(d)
    return out


def _due(spark, sf):
    return T.checks(spark, sf).orderBy("checked_at", "id").limit(C.VERIFY_LIMIT)


def sentinel_run(spark, sf):
    """What one run over the oldest observations appends."""
    appended, _ = C.sentinel(_due(spark, sf), _seen(spark, sf), T.EVENTS_NOW)
    return appended.groupBy("artifact_id", "http_status", "ok", dates.iso(F.col("checked_at")).alias("checked_at")).agg(F.count(F.lit(1)).alias("n"))


def sentinel_report(spark, sf):
    """Its report, of all and of a small catalog, which blocks."""
    live = _seen(spark, sf)
    out = None
    for name, rows in (("all", live), ("small", live.filter("artifact_id <= 30"))):
        r = C.sentinel(_due(spark, sf), rows, T.EVENTS_NOW)[1].select(F.lit(name).alias("which"), "*")
        out = r if out is None else out.unionByName(r)
    return out


def by_reason(spark, sf):
    return C.by_reason(_reasons(spark, sf))


def prune_candidates(spark, sf):
    active = T.read(spark, sf, "events").select(F.expr("event_id div 3").alias("artifact_id")).distinct().filter("artifact_id % 5 <> 0")
    return C.prune_candidates(T.checks(spark, sf, sparse=True), active)


def safety_ratio(spark, sf):
    c = T.checks(spark, sf)
    out = None
    for name, ids in (("all", None), ("few", 7)):
        gone = c.filter("http_status = 404").select("artifact_id").distinct()
        gone = gone if ids is None else gone.filter(F.col("artifact_id") % ids == 0)
        row = C.safety_ratio(gone, c.select("artifact_id").distinct()).select(F.lit(name).alias("which"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def trim_checks(spark, sf):
    kept, gone = C.trim(T.checks(spark, sf), "2024-04-10 00:00:00")
    return kept.select(F.lit("kept").alias("what")).unionByName(gone.select(F.lit("deleted").alias("what"))).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


def verify_queue(spark, sf):
    a = T.read(spark, sf, "customer").select(F.col("c_custkey").alias("artifact_id"), F.col("c_mktsegment").alias("segment")).filter("segment <> 'BUILDING'")
    return C.verify_queue(a, T.checks(spark, sf)).select("artifact_id", dates.iso(F.col("last_checked")).alias("last_checked"))


def verify_queue_rows(spark, sf):
    """The queue by check rows instead of records: the oldest observations, so a record can come more than once."""
    a = T.read(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("artifact_id"))
    return T.checks(spark, sf).join(a, "artifact_id").orderBy("checked_at", "id").limit(C.VERIFY_LIMIT).select("id", "artifact_id")


def reactivated(spark, sf):
    """Records whose last observation is good although they were gone or unreachable before it."""
    v = T.checks(spark, sf).filter(status.verdict(F.col("http_status")) != "ok").select("artifact_id").distinct()
    last = C.latest_check(T.checks(spark, sf)).filter(status.verdict(F.col("http_status")) == "ok")
    return last.join(v, "artifact_id", "left_semi").select("artifact_id", "id")


def _daily(spark, sf):
    return T.checks(spark, sf).withColumn("day", F.date_format("checked_at", "yyyy-MM-dd"))


def circuit_breaker(spark, sf):
    return C.circuit_breaker(_daily(spark, sf), "day")


def circuit_breaker_wide(spark, sf):
    """The same with a limit that not every day exceeds."""
    return C.circuit_breaker(_daily(spark, sf), "day", limit=60)


_SEEN = "seen AS (SELECT o_custkey AS artifact_id, max(o_orderdate) AS last_seen_at FROM orders GROUP BY o_custkey)"
_REASON = f"""WITH {T.checks_sql()}, {_SEEN}, v AS (SELECT *, {T.VERDICT_SQL} AS v FROM checks),
  m AS (SELECT *, max(CASE WHEN v = 'ok' THEN (checked_at, id) END) OVER (PARTITION BY artifact_id) AS ok FROM v),
  days AS (SELECT artifact_id, checked_at::DATE AS day, max((checked_at, id)) AS last, any_value(ok) AS ok FROM m WHERE v = 'transient' GROUP BY 1, 2),
  r AS (SELECT artifact_id, count(*) AS run FROM days WHERE ok IS NULL OR last > ok GROUP BY 1),
  t AS (SELECT artifact_id, bool_or(v = 'terminal') AS terminal FROM v GROUP BY 1),
  joined AS (SELECT s.artifact_id, coalesce(terminal, false) AS terminal, coalesce(run, 0) AS run,
    greatest(floor((epoch_us(TIMESTAMP '{T.ORDERS_NOW}') - epoch_us(last_seen_at)) / 86400000000.0), 0)::BIGINT AS days_old
    FROM seen s LEFT JOIN t ON t.artifact_id = s.artifact_id LEFT JOIN r ON r.artifact_id = s.artifact_id),
  reasons AS (SELECT *, CASE WHEN terminal THEN 'gone' WHEN run >= 3 THEN 'unreachable' WHEN days_old > 180 THEN 'stale' END AS reason FROM joined) """
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"



def _breaker(limit: int) -> str:
    bad = f"count(*) FILTER ({T.VERDICT_SQL} <> 'ok')"
    return f"WITH {T.checks_sql()} SELECT strftime(checked_at, '%Y-%m-%d') AS day, count(*) AS checked, {bad} AS failed, 100 * {bad} > {limit} * count(*) AS tripped FROM checks GROUP BY 1"


QUERIES = {f.__name__: f for f in [classify_status, verdict_tally, latest_check, inactive_reason, prune_decisions, sentinel_run, sentinel_report, by_reason, prune_candidates, safety_ratio, trim_checks, verify_queue, verify_queue_rows, reactivated, circuit_breaker, circuit_breaker_wide]}

ORACLE = {
    "classify_status": f"WITH {T.checks_sql()} SELECT id, {T.VERDICT_SQL} AS verdict FROM checks",
    "verdict_tally": f"WITH {T.checks_sql()} SELECT {T.VERDICT_SQL} AS verdict, count(*) AS n FROM checks GROUP BY 1",
    "latest_check": f"WITH {T.checks_sql()}, n AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY checked_at DESC, id DESC) AS k FROM checks) SELECT artifact_id, {_ISO.format('checked_at')} AS checked_at, id, http_status FROM n WHERE k = 1",
    "inactive_reason": _REASON + "SELECT * FROM reasons",
    "prune_decisions": _REASON + """, few AS (SELECT * FROM reasons WHERE reason IS NOT NULL AND artifact_id % 16 = 0), n AS (SELECT count(*) AS live FROM seen)
      SELECT 'all' AS run, artifact_id, reason, 100 * (SELECT count(reason) FROM reasons) <= 10 * live AS deactivate FROM reasons, n WHERE reason IS NOT NULL
      UNION ALL SELECT 'few', artifact_id, reason, 100 * (SELECT count(*) FROM few) <= 10 * live FROM few, n UNION ALL SELECT 'dry', artifact_id, reason, false FROM few""",
    "sentinel_run": f"WITH {T.checks_sql()}, due AS (SELECT * FROM checks ORDER BY checked_at, id LIMIT 300) SELECT artifact_id, http_status, false AS ok, '2024-01-31T00:00:00Z' AS checked_at, count(*) AS n FROM due WHERE {T.VERDICT_SQL} <> 'ok' GROUP BY 1, 2",
    "sentinel_report": f"""WITH {T.checks_sql()}, {_SEEN}, due AS (SELECT *, {T.VERDICT_SQL} AS v FROM checks ORDER BY checked_at, id LIMIT 300),
      t AS (SELECT count(*) AS checked, count(*) FILTER (v = 'ok') AS ok, count(*) FILTER (v <> 'ok') AS failed, count(*) FILTER (v = 'terminal') AS gone FROM due),
      n AS (SELECT 'all' AS which, count(*) AS live FROM seen UNION ALL SELECT 'small', count(*) FROM seen WHERE artifact_id <= 30)
      SELECT which, checked, ok, failed, live > 0 AND 100 * gone > 10 * live AS blocked FROM t, n""",
    "by_reason": _REASON + "SELECT k.reason, count(r.reason) AS n FROM (SELECT unnest(['gone', 'unreachable', 'stale']) AS reason) k LEFT JOIN reasons r ON r.reason = k.reason GROUP BY 1",
    "prune_candidates": f"WITH {T.checks_sql(True)} SELECT artifact_id, count(CASE WHEN http_status IN (404, 410) THEN 1 END) AS terminal, count(CASE WHEN http_status IN (403, 429, 500, 502, 503, 504) THEN 1 END) AS transient, last(http_status ORDER BY checked_at, id) AS last_status FROM checks WHERE artifact_id % 5 <> 0 GROUP BY artifact_id HAVING terminal >= 1 OR transient >= 3",
    "safety_ratio": f"""WITH {T.checks_sql()}, live AS (SELECT count(DISTINCT artifact_id) AS live FROM checks),
      c AS (SELECT 'all' AS which, count(DISTINCT artifact_id) AS candidates FROM checks WHERE http_status = 404 UNION ALL SELECT 'few', count(DISTINCT artifact_id) FROM checks WHERE http_status = 404 AND artifact_id % 7 = 0)
      SELECT which, candidates, live, round(100.0 * candidates / live)::BIGINT AS ratio_pct, 100 * candidates > 10 * live AS blocked FROM c, live""",
    "trim_checks": f"WITH {T.checks_sql()} SELECT CASE WHEN checked_at < TIMESTAMP '2024-04-10 00:00:00' - INTERVAL 90 DAY THEN 'deleted' ELSE 'kept' END AS what, count(*) AS n FROM checks GROUP BY 1",
    "verify_queue": f"WITH {T.checks_sql()}, l AS (SELECT artifact_id, max(checked_at) AS m FROM checks GROUP BY 1) SELECT c_custkey AS artifact_id, {_ISO.format('m')} AS last_checked FROM customer LEFT JOIN l ON l.artifact_id = c_custkey WHERE c_mktsegment <> 'BUILDING' ORDER BY m ASC NULLS FIRST, c_custkey LIMIT 300",
    "circuit_breaker": _breaker(40),
    "circuit_breaker_wide": _breaker(60),
    "verify_queue_rows": f"WITH {T.checks_sql()} SELECT id, artifact_id FROM checks JOIN customer ON c_custkey = artifact_id WHERE c_mktsegment <> 'BUILDING' ORDER BY checked_at, id LIMIT 300",
    "reactivated": f"WITH {T.checks_sql()}, n AS (SELECT *, {T.VERDICT_SQL} AS v, row_number() OVER (PARTITION BY artifact_id ORDER BY checked_at DESC, id DESC) AS k FROM checks) SELECT artifact_id, id FROM n WHERE k = 1 AND v = 'ok' AND artifact_id IN (SELECT artifact_id FROM n WHERE v <> 'ok')",
}
