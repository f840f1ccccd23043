"""Queries of the read side and of scheduling."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import dates, taxonomy
from curatrix.functions import text as slugs
from curatrix.functions import url as safe
from curatrix.operators import browse as B
from curatrix.plans import tables as T

COLUMNS = ["id", "name", "kind", "quality_score"]
WITH = f"WITH {T.CATALOG_SQL} "
TOP = "SELECT id, name, kind, quality_score FROM catalog WHERE is_active"


def _rows(spark, sf):
    return T.catalog(spark, sf).select(*COLUMNS, "is_active")


def active_filter(spark, sf):
    return B.active(_rows(spark, sf)).select(*COLUMNS)


def filter_isin(spark, sf):
    return B.of_kinds(_rows(spark, sf), "subagent", "command").select(*COLUMNS)


def point_lookup(spark, sf):
    return B.by_url(T.catalog(spark, sf), "https://catalog.example.com/part/42").select(*COLUMNS, "is_active")


def top_by_kind(spark, sf):
    return B.top(_rows(spark, sf), "skill").select(*COLUMNS)


def top_all(spark, sf):
    return B.top(_rows(spark, sf)).select(*COLUMNS)


def paginate(spark, sf):
    return B.page(_rows(spark, sf), "mcp", 3).select(*COLUMNS)


def page_meta(spark, sf):
    return B.page_meta(_rows(spark, sf), 2)


def clamp_args(spark, sf):
    p = T.read(spark, sf, "part").select("p_partkey", (F.col("p_size") * 5 - 20).alias("asked"))
    return p.select("p_partkey", B.clamp_limit(F.col("asked")).alias("size"), B.clamp_page(F.col("asked") - 30).alias("page"))


def recent_feed(spark, sf):
    seen = T.read(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last_seen_at"))
    return B.recent(seen.withColumn("is_active", F.col("id") % 7 != 0)).select("id", "last_seen_at")


def enrich_queue(spark, sf):
    d = T.read(spark, sf, "documents").join(T.read(spark, sf, "labels"), "doc_id", "left")
    rows = d.select(F.col("doc_id").alias("id"), F.col("quality").alias("enriched_at"), F.col("n_chars").alias("last_seen_at"), F.lit(True).alias("is_active"))
    return B.enrich_queue(rows).select("id", "last_seen_at")


def _scored(spark, sf):
    """Records with the times of their last sighting and scoring, some of which are behind or missing."""
    seen = T.last_seen(spark, sf).select(F.col("artifact_id").alias("id"), "last_seen_at", (F.col("artifact_id") % 6 != 0).alias("is_active"))
    days = F.make_interval(days=(F.col("id") % 5).cast("int") - 2)
    return seen.withColumn("enriched_at", F.when(F.col("id") % 4 != 0, F.col("last_seen_at").cast("timestamp") + days))


def enrich_stale(spark, sf):
    return B.stale_queue(_scored(spark, sf)).select("id", dates.iso(F.col("enriched_at")).alias("enriched_at"))


def enrich_forced(spark, sf):
    return B.stale_queue(_scored(spark, sf), force=True).select("id", dates.iso(F.col("enriched_at")).alias("enriched_at"))


def count_by_kind(spark, sf):
    return B.count_by_kind(_rows(spark, sf))


def live_count(spark, sf):
    return B.active(_rows(spark, sf)).agg(F.count(F.lit(1)).alias("live"))


def due_sources(spark, sf):
    return B.due_sources(T.sources(spark, sf), T.EVENTS_NOW).select("id", "locator", dates.iso(F.col("last_run_at")).alias("last_run_at"))


def stamp_due(spark, sf):
    s = T.sources(spark, sf)
    return B.stamp(s, B.due_sources(s, T.EVENTS_NOW), T.EVENTS_NOW).select("id", dates.iso(F.col("last_run_at")).alias("last_run_at"))


def lock_decisions(spark, sf):
    e = T.read(spark, sf, "events").filter("event_type = 'signup'")
    locks = e.groupBy(F.concat(F.lit("lock-"), F.col("user_id").cast("string")).alias("name")).agg(F.max("ts").alias("m"))
    locks = locks.select("name", F.lit("holder@1").alias("holder"), (F.col("m").cast("timestamp") + F.expr("INTERVAL 1200 SECONDS")).alias("expires_at"))
    # Every third lock is asked for twice; the second request came first.
    c = T.read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("lock-"), F.col("c_custkey").cast("string")).alias("name"))
    asked = c.select("name", F.lit("crawler@2").alias("holder"), F.lit(2).alias("pos")).unionByName(c.filter("k % 3 = 0").select("name", F.lit("pruner@3").alias("holder"), F.lit(1).alias("pos")))
    out = B.lock_decisions(asked, locks, "2024-01-30 12:00:00")
    return out.withColumn("expires_at", dates.iso(F.col("expires_at")))


def _categorized(spark, sf):
    c = T.catalog(spark, sf)
    return c.withColumn("categories", taxonomy.map_categories(F.col("kind"), F.col("tags"), F.col("install_target")))


def map_categories(spark, sf):
    return _categorized(spark, sf).select("id", F.array_join("categories", ",").alias("categories"))


def example_signals(spark, sf):
    return T.catalog(spark, sf).select("id", F.array_join(taxonomy.example_signals(F.col("tags"), F.col("install_target")), ",").alias("signals"))


def _counted(spark, sf):
    known = spark.createDataFrame([(k, 300) for k in [*taxonomy.KINDS, taxonomy.UNCATEGORIZED, "empty"]], "slug string, artifact_count int")
    return B.recount(known, _categorized(spark, sf))


def taxonomy_recount(spark, sf):
    return _counted(spark, sf).select("slug", "recount")


def drift_corrected(spark, sf):
    return B.drift(_counted(spark, sf))


def source_health(spark, sf):
    from curatrix.operators.checks import failure_runs

    return failure_runs(T.runs(spark, sf)).withColumn("last_run_at", dates.iso(F.col("last_run_at")))


def monthly_rollup(spark, sf):
    out = B.monthly_rollup(T.runs(spark, sf), "2000-08-02 00:00:00")
    return out.withColumn("month", F.date_format("month", "yyyy-MM"))


def pulse_guards(spark, sf):
    r = T.runs(spark, sf).withColumn("pulse", F.date_format("started_at", "yyyy-MM-dd"))
    return B.pulse_guards(r, "pulse")


def click_counts(spark, sf):
    e = T.read(spark, sf, "events").filter("event_type = 'click'")
    return e.groupBy(F.col("user_id").alias("artifact_id")).agg(F.count(F.lit(1)).alias("clicks"))


def degraded_banner(spark, sf):
    r = T.runs(spark, sf).filter("status <> 'failed'").withColumnRenamed("started_at", "finished_at")
    return B.degraded(r, T.ORDERS_NOW).withColumn("last_pulse", dates.iso(F.col("last_pulse")))


def landing_stats(spark, sf):
    rows, now = _rows(spark, sf), T.EVENTS_NOW
    by_kind = B.count_by_kind(rows).select(F.concat(F.lit("kind:"), F.coalesce("kind", F.lit("none"))).alias("what"), "n")
    live = B.active(rows).agg(F.count(F.lit(1)).alias("n")).select(F.lit("live").alias("what"), "n")
    due = B.due_sources(T.sources(spark, sf), now).agg(F.count(F.lit(1)).alias("n")).select(F.lit("due").alias("what"), "n")
    return by_kind.unionByName(live).unionByName(due)


def list_categories(spark, sf):
    return _counted(spark, sf).orderBy("slug").select("slug", "artifact_count", "recount")


def taxonomy_like(spark, sf):
    """The substring form of the recount: case-insensitive, so one slug can count for another that holds it."""
    c = B.active(_categorized(spark, sf)).select(F.array_join("categories", ",").alias("c"))
    known = spark.createDataFrame([(k,) for k in [*taxonomy.KINDS, "SKILL", "m"]], "slug string")
    return F.broadcast(known).join(c, F.expr("c ILIKE concat('%', slug, '%')"), "left").groupBy("slug").agg(F.count("c").alias("recount"))


def sitemap(spark, sf):
    rows = B.active(T.catalog(spark, sf)).filter(safe.is_safe_url(F.col("source_url")))
    return rows.select(F.concat(F.lit("/artifact/"), slugs.slugify(F.concat_ws("-", "name", F.col("id").cast("string")))).alias("loc"))


def detail_page(spark, sf):
    """Records with their score and their last check."""
    from curatrix.operators.checks import latest_check

    rows = B.active(_rows(spark, sf))
    last = latest_check(T.checks(spark, sf)).select(F.col("artifact_id").alias("id"), "checked_at", "http_status")
    return rows.join(last, "id", "left").select("id", "name", "quality_score", dates.iso(F.col("checked_at")).alias("last_checked"), "http_status")


def click_redirects(spark, sf):
    """Where clicks lead: the stored address, checked again, of a record that is still active."""
    clicks = T.read(spark, sf, "events").filter("event_type = 'click'").select("event_id", F.col("user_id").alias("id"))
    rows = B.active(T.catalog(spark, sf)).filter(safe.is_safe_url(F.col("source_url"))).select("id", "source_url")
    return clicks.join(rows, "id").select("event_id", F.col("source_url").alias("location"))


def ai_overlay(spark, sf):
    from curatrix.operators.overlay import overlay

    c = T.catalog(spark, sf).withColumn("summary", F.col("name")).select(*COLUMNS, "summary", "tags")
    told = c.filter("id % 3 = 0").select("id", F.when(F.col("id") % 6 == 0, F.concat(F.lit("about "), F.col("id").cast("string"))).alias("summary"), F.array(F.lit("cli"), F.lit("extra")).alias("tags"))
    return overlay(c, told).select("id", "quality_score", "summary", F.array_join("tags", ",").alias("tags"))


def health_rollup(spark, sf):
    from curatrix.operators.checks import failure_runs

    return failure_runs(T.runs(spark, sf)).groupBy("health").agg(F.count(F.lit(1)).alias("sources"), F.max("consecutive_failures").alias("worst"))


def _tag_sql(table: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


_KINDS = ", ".join(f"'{k}'" for k in taxonomy.KINDS)
_EXAMPLE = ", ".join(f"'{k}'" for k in taxonomy.EXAMPLE_TAGS)
_EXAMPLE_T = ", ".join(f"'{k}'" for k in taxonomy.EXAMPLE_TARGETS)
# Distinct in first-seen order: keep an element where its first place is its own.
_ORDERED = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_FOUND = f"""list_filter(list_concat([kind], list_transform(tags, lambda t: {_tag_sql(taxonomy.TAG_CATEGORY)}[lower(t)]),
  list_transform(install_target, lambda t: {_tag_sql(taxonomy.TARGET_CATEGORY)}[t])), lambda x: x IS NOT NULL)"""
_CATS = f"""found AS (SELECT *, {_FOUND} AS f FROM catalog), categorized AS (
  SELECT *, CASE WHEN len(f) = 0 THEN ['{taxonomy.UNCATEGORIZED}'] ELSE {_ORDERED.format("f")} END AS categories FROM found)"""
_DUE = "enabled AND (last_run_at IS NULL OR last_run_at + to_hours(cadence_hours::BIGINT) <= TIMESTAMP '2024-01-31 00:00:00')"
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"
_KNOWN = "known AS (SELECT unnest([" + ", ".join(f"'{k}'" for k in [*taxonomy.KINDS, taxonomy.UNCATEGORIZED, "empty"]) + "]) AS slug)"
_RECOUNT = f"{WITH}, {_CATS}, {_KNOWN}, counted AS (SELECT k.slug, count(c.slug) AS recount FROM known k LEFT JOIN (SELECT unnest(categories) AS slug FROM categorized WHERE is_active) c ON c.slug = k.slug GROUP BY k.slug)"

_SCORED = """WITH s AS (SELECT o_custkey AS id, max(o_orderdate)::TIMESTAMP AS m, CASE WHEN o_custkey % 4 <> 0 THEN max(o_orderdate)::TIMESTAMP + to_days((o_custkey % 5 - 2)::INT) END AS e
  FROM orders WHERE o_custkey % 6 <> 0 GROUP BY o_custkey) """

QUERIES = {f.__name__: f for f in [active_filter, filter_isin, point_lookup, top_by_kind, top_all, paginate, page_meta, clamp_args, recent_feed, enrich_queue, enrich_stale, enrich_forced, count_by_kind, live_count, due_sources, stamp_due, lock_decisions, map_categories, example_signals, taxonomy_recount, drift_corrected, source_health, monthly_rollup, pulse_guards, click_counts, degraded_banner, landing_stats, list_categories, taxonomy_like, sitemap, detail_page, click_redirects, ai_overlay, health_rollup]}

ORACLE = {
    "active_filter": WITH + TOP,
    "filter_isin": WITH + TOP + " AND kind IN ('subagent', 'command')",
    "point_lookup": WITH + "SELECT id, name, kind, quality_score, is_active FROM catalog WHERE source_url = 'https://catalog.example.com/part/42'",
    "top_by_kind": WITH + TOP + " AND kind = 'skill' ORDER BY quality_score DESC, id LIMIT 24",
    "top_all": WITH + TOP + " ORDER BY quality_score DESC, id LIMIT 24",
    "paginate": WITH + TOP + " AND kind = 'mcp' ORDER BY quality_score DESC, id LIMIT 24 OFFSET 48",
    "page_meta": WITH + "SELECT kind, count(*) AS total, ceil(count(*) / 24.0)::BIGINT AS pages, ceil(count(*) / 24.0) > 2 AS has_next, true AS has_prev FROM catalog WHERE is_active GROUP BY kind",
    "clamp_args": "SELECT p_partkey, CASE WHEN p_size * 5 - 20 <= 0 THEN 24 ELSE least(p_size * 5 - 20, 100) END AS size, greatest(p_size * 5 - 50, 1) AS page FROM part",
    "recent_feed": "SELECT user_id AS id, max(ts) AS last_seen_at FROM events WHERE user_id % 7 <> 0 GROUP BY user_id ORDER BY last_seen_at DESC, id LIMIT 8",
    "enrich_queue": "SELECT d.doc_id AS id, n_chars AS last_seen_at FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL ORDER BY n_chars DESC, id LIMIT 100",
    "enrich_stale": _SCORED + f"SELECT id, {_ISO.format('e')} AS enriched_at FROM s WHERE e IS NULL OR e < m ORDER BY e ASC NULLS FIRST, id LIMIT 100",
    "enrich_forced": _SCORED + f"SELECT id, {_ISO.format('e')} AS enriched_at FROM s ORDER BY e ASC NULLS FIRST, id LIMIT 100",
    "count_by_kind": WITH + "SELECT kind, count(*) AS n FROM catalog WHERE is_active GROUP BY kind",
    "live_count": WITH + "SELECT count(*) AS live FROM catalog WHERE is_active",
    "due_sources": f"WITH {T.SOURCES_SQL} SELECT id, locator, {_ISO.format('last_run_at')} AS last_run_at FROM (SELECT * FROM sources WHERE {_DUE} ORDER BY last_run_at ASC NULLS FIRST, id LIMIT 100)",
    "stamp_due": f"WITH {T.SOURCES_SQL}, due AS (SELECT id FROM sources WHERE {_DUE} ORDER BY last_run_at ASC NULLS FIRST, id LIMIT 100) SELECT id, {_ISO.format("CASE WHEN id IN (SELECT id FROM due) THEN TIMESTAMP '2024-01-31 00:00:00' ELSE last_run_at END")} AS last_run_at FROM sources",
    "lock_decisions": f"""WITH locks AS (SELECT 'lock-' || user_id AS name, max(ts) + INTERVAL 1200 SECOND AS u FROM events WHERE event_type = 'signup' GROUP BY user_id),
      asked AS (SELECT c_custkey, 'crawler@2' AS holder, 2 AS pos FROM customer UNION ALL SELECT c_custkey, 'pruner@3', 1 FROM customer WHERE c_custkey % 3 = 0),
      met AS (SELECT 'lock-' || c_custkey AS name, holder, pos, u, coalesce(u <= TIMESTAMP '2024-01-30 12:00:00', true) AS free, row_number() OVER (PARTITION BY c_custkey ORDER BY pos) AS turn FROM asked LEFT JOIN locks ON locks.name = 'lock-' || c_custkey)
      SELECT name, holder, pos, free AND turn = 1 AS acquired, CASE WHEN NOT free THEN 'holder@1' WHEN turn > 1 THEN 'pruner@3' END AS blocked_by, {_ISO.format("CASE WHEN free THEN TIMESTAMP '2024-01-30 12:20:00' ELSE u END")} AS expires_at FROM met""",
    "map_categories": f"{WITH}, {_CATS} SELECT id, array_to_string(categories, ',') AS categories FROM categorized",
    "example_signals": f"{WITH}, found AS (SELECT id, list_concat(list_filter(list_transform(tags, lambda t: lower(t)), lambda t: t IN ({_EXAMPLE})), list_filter(install_target, lambda t: t IN ({_EXAMPLE_T}))) AS f FROM catalog) SELECT id, coalesce(array_to_string({_ORDERED.format('f')}, ','), '') AS signals FROM found",
    "taxonomy_recount": f"{_RECOUNT} SELECT slug, recount FROM counted",
    "drift_corrected": f"{_RECOUNT} SELECT count(*) FILTER (recount <> 300) AS drift_corrected FROM counted",
    "source_health": f"""WITH {T.RUNS_SQL}, marked AS (SELECT *, max(CASE WHEN status <> 'failed' THEN (started_at, id) END) OVER (PARTITION BY source_id) AS ok FROM runs),
      n AS (SELECT source_id, max(started_at) AS m, count(*) FILTER (status = 'failed' AND (ok IS NULL OR (started_at, id) > ok)) AS c FROM marked GROUP BY source_id)
      SELECT source_id, {_ISO.format('m')} AS last_run_at, c AS consecutive_failures, CASE WHEN c = 0 THEN 'healthy' WHEN c < 3 THEN 'degraded' ELSE 'failing' END AS health FROM n""",
    "monthly_rollup": f"WITH {T.RUNS_SQL} SELECT source_id, strftime(started_at, '%Y-%m') AS month, count(*) AS runs, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failed') AS failed FROM runs WHERE started_at < TIMESTAMP '2000-08-02 00:00:00' GROUP BY 1, 2",
    "pulse_guards": f"WITH {T.RUNS_SQL}, p AS (SELECT strftime(started_at, '%Y-%m-%d') AS pulse, sum(accepted)::BIGINT AS accepted, count(*) FILTER (status = 'failed') AS failed FROM runs GROUP BY 1) SELECT *, accepted >= 1 AND failed < 3 AS healthy FROM p",
    "click_counts": "SELECT user_id AS artifact_id, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY user_id",
    "degraded_banner": f"WITH {T.RUNS_SQL}, l AS (SELECT max(started_at) AS m FROM runs WHERE status <> 'failed') SELECT {_ISO.format('m')} AS last_pulse, m < TIMESTAMP '2001-08-02 00:00:00' - INTERVAL 48 HOUR AS degraded FROM l",
    "landing_stats": f"{WITH}, {T.SOURCES_SQL} SELECT 'kind:' || coalesce(kind, 'none') AS what, count(*) AS n FROM catalog WHERE is_active GROUP BY kind UNION ALL SELECT 'live', count(*) FROM catalog WHERE is_active UNION ALL SELECT 'due', least(count(*), 100) FROM sources WHERE {_DUE}",
    "list_categories": f"{_RECOUNT} SELECT slug, 300 AS artifact_count, recount FROM counted ORDER BY slug",
    "taxonomy_like": f"{WITH}, {_CATS} SELECT slug, count(id) AS recount FROM (SELECT unnest(['skill', 'mcp', 'ruleset', 'subagent', 'command', 'SKILL', 'm']) AS slug) k LEFT JOIN categorized c ON c.is_active AND array_to_string(c.categories, ',') ILIKE '%' || slug || '%' GROUP BY slug",
    "sitemap": f"{WITH} SELECT '/artifact/' || {T.SLUG_SQL.format("(name || '-' || id)")} AS loc FROM catalog WHERE is_active",
    "detail_page": f"{WITH}, {T.checks_sql()}, n AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY checked_at DESC, id DESC) AS k FROM checks) SELECT c.id, name, quality_score, {_ISO.format('checked_at')} AS last_checked, http_status FROM catalog c LEFT JOIN n ON n.artifact_id = c.id AND k = 1 WHERE is_active",
    "ai_overlay": f"{WITH} SELECT id, quality_score, CASE WHEN id % 6 = 0 THEN 'about ' || id ELSE name END AS summary, array_to_string(list_concat(tags, CASE WHEN id % 3 = 0 THEN list_filter(['cli', 'extra'], lambda x: NOT list_contains(tags, x)) ELSE [] END), ',') AS tags FROM catalog",
    "click_redirects": f"{WITH} SELECT event_id, source_url AS location FROM events JOIN catalog ON id = user_id WHERE event_type = 'click' AND is_active",
}
ORACLE["health_rollup"] = f"SELECT health, count(*) AS sources, max(consecutive_failures) AS worst FROM ({ORACLE['source_health']}) GROUP BY health"
