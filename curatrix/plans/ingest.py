"""Queries of the write path: validation, outcomes, snapshots, reports, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import validate
from curatrix.functions.taxonomy import KINDS
from curatrix.lineage import shared_dir
from curatrix.operators import search, upsert
from curatrix.operators.search_index import SearchIndex, signature
from curatrix.plans import stem_sql
from curatrix.plans import tables as T
from curatrix.plans.scoring import U16_SQL
from curatrix.store import Store

NOW = "2024-06-01 00:00:00"
CONTENT = ["kind", "name", "summary", "author", "content_hash"]


def _outcomes(spark, sf):
    return upsert.outcomes(T.batch(spark, sf), T.stored(spark, sf))


def upsert_outcomes(spark, sf):
    return _outcomes(spark, sf).select("id", "outcome")


def slug_collisions(spark, sf):
    return _outcomes(spark, sf).filter("outcome = 'rejected'").select("id", "source_url", "slug")


def ingest_report(spark, sf):
    return upsert.report(_outcomes(spark, sf), "kind")


def _snapshot(spark, sf):
    return upsert.snapshot(T.batch(spark, sf), T.stored(spark, sf).withColumn("id", F.col("id")), NOW, CONTENT)


def shown(s):
    """A catalog's columns as the queries show them."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return s.select("source_url", "slug", "kind", F.sha2("name", 256).alias("name_sha256"), "content_hash", "quality_score", F.array_join("categories", ",").alias("categories"), iso("first_seen_at"), iso("last_seen_at"), iso("enriched_at"))


def upsert_snapshot(spark, sf):
    return shown(_snapshot(spark, sf))


def reactivation(spark, sf):
    return _snapshot(spark, sf).select("source_url", "is_active", "inactive_reason")


def chunk_ids(spark, sf):
    return upsert.chunk_ids(T.corpus(spark, sf).select("id"), "id")


def _chunks(spark, sf):
    done = upsert.chunk_ids(_outcomes(spark, sf), "id")
    n = F.count(F.lit(1))
    bad = F.count_if(F.col("outcome") == "rejected")
    errors = F.array_sort(F.array_compact(F.collect_list(F.when(F.col("outcome") == "rejected", F.concat(F.lpad(F.col("id").cast("string"), 9, "0"), F.lit(": slug taken"))))))
    return done.groupBy("kind", "chunk").agg(n.alias("attempted"), (n - bad).alias("accepted"), bad.alias("rejected"), F.when(n == bad, 1).otherwise(0).alias("failed_chunks"), errors.alias("errors"))


def merge_outcomes(spark, sf):
    m = upsert.merge_outcomes(_chunks(spark, sf), "kind")
    return m.withColumn("errors", F.array_join("errors", "|"))


def run_status(spark, sf):
    m = upsert.merge_outcomes(_chunks(spark, sf), "kind")
    return m.select("kind", upsert.run_status(F.col("attempted"), F.col("accepted"), F.col("failed_chunks")).alias("status"))


def run_evidence(spark, sf):
    """One evidence row per call, here per kind: counts, status and the first errors."""
    m = upsert.merge_outcomes(_chunks(spark, sf), "kind")
    status = upsert.run_status(F.col("attempted"), F.col("accepted"), F.col("failed_chunks"))
    return m.select(F.concat(F.lit("crawler@"), F.col("kind")).alias("agent"), F.lit("2024-06-01T00:00:00Z").alias("finished_at"), status.alias("status"), F.col("attempted").alias("discovered"), "accepted", "rejected", F.size("errors").alias("errors"))


def _wire(spark, sf):
    c = T.corpus(spark, sf)
    i = F.col("id")
    url = F.when(i % 13 == 0, F.lit("javascript:alert(1)")).when(i % 17 != 0, F.col("source_url"))
    tags = F.when(i % 19 == 0, F.lit(None).cast("array<string>")).when(i % 23 == 0, F.array_repeat(F.lit("t"), 26)).when(i % 29 == 0, F.array(F.lit("a"), F.lit(None).cast("string"))).otherwise(F.array(F.lit("a")))
    targets = F.when(i % 31 == 0, F.array(F.lit("emacs"), F.lit("cursor"), F.lit("vim"))).when(i % 37 != 0, F.array(F.lit("zed")))
    kind = F.when(i % 11 == 0, F.lit("plugin")).otherwise(F.lit("skill"))
    return c.select("id", kind.alias("kind"), F.when(i % 41 == 0, F.lit(" ")).otherwise(F.col("name")).alias("name"), url.alias("source_url"), "summary", "description", tags.alias("tags"), targets.alias("install_target"), F.when(i % 43 == 0, -5).otherwise(i % 7).alias("stars"), F.lit(None).cast("bigint").alias("forks"))


def validation_issues(spark, sf):
    return validate.issue_table(_wire(spark, sf), "id")


def batch_verdict(spark, sf):
    """Batches by source of at most any size: accepted only without a single issue."""
    w = _wire(spark, sf).withColumn("batch", F.expr("id div 10"))
    c = [F.col(n) for n in ("kind", "name", "source_url", "summary", "description", "tags", "install_target", "stars", "forks")]
    n = w.groupBy("batch").agg(F.count(F.lit(1)).alias("size"), F.sum(F.size(validate.issues(*c))).alias("issues"))
    body = F.size(validate.body_issues(F.lit("crawler"), F.col("size")))
    return n.select("batch", (F.col("issues") + body).alias("issues"), (F.col("issues") + body == 0).alias("accepted"))


def exclusion_antijoin(spark, sf):
    removed = T.corpus(spark, sf).filter("id % 7 = 0").select("source_url")
    return upsert.exclude(T.corpus(spark, sf).select("id", "source_url"), removed)


def fork_dedup(spark, sf):
    stars = (F.col("id") * 7919) % 1000
    c = T.corpus(spark, sf).withColumn("seen", F.col("id") % 50).withColumn("stars", stars)
    return upsert.fork_dedup(c, "content_hash", F.col("seen"), F.desc("stars"), F.col("id")).select("id", "content_hash")


def _searched(spark, sf):
    """Records with the searched columns, and what a page shows; every seventh is not active."""
    c = T.corpus(spark, sf).withColumn("tags", F.array("kind", "author"))
    return c.select("id", *search.FIELDS, (F.col("id") % 7 != 0).alias("is_active"), (F.col("id") % 13).alias("quality_score"))


def _index(spark, sf):
    """The stored index of the records; built when the table's files are not the ones that an index is there for."""
    index = SearchIndex(Store(spark, f"{shared_dir(spark)}/curatrix/search-blocks"), signature(spark, [f"{sf}/documents.parquet"]))
    if not index.store.version(index.name):
        index.build(_searched(spark, sf))
    return index


def fts_match(spark, sf):
    return _index(spark, sf).search('the "RIGHTS" reserving*')


def fts_unstemmed(spark, sf):
    return _index(spark, sf).search('the "THÉ" of*', stemmed=False)


def fts_column_match(spark, sf):
    return _index(spark, sf).search("the", field="name")


def fts_page(spark, sf):
    """The second page of active records for a term, joined back to their columns."""
    found = search.search_page(_searched(spark, sf), "the", page=2, index=_index(spark, sf))
    return found.select("id", "hits", "quality_score", F.sha2("name", 256).alias("name_sha256"))


def fts_postings(spark, sf):
    return _index(spark, sf).frequencies()


def fts_vocabulary(spark, sf):
    return _index(spark, sf).dictionary()


def fts_scan(spark, sf):
    """The same search of records that have no index."""
    return search.search(_searched(spark, sf), 'the "RIGHTS" reserving*')


def retired_reasons(spark, sf):
    """Records that were asked to be removed, and copies of a preferred one."""
    rows = T.corpus(spark, sf).withColumn("source_url", F.concat(F.lit("https://docs.example.com/at/"), F.col("id").cast("string")))
    removed = rows.filter("id % 50 = 7").select("source_url")
    return upsert.retired(rows, removed, "content_hash", F.col("id"))


_BASE = f"WITH RECURSIVE {T.CORPUS_SQL}, {T.STORED_SQL}, {T.BATCH_SQL}"
#: New keys' records one after the other: a record comes in if its key has not and its slug is free.
_GREEDY = """f AS (SELECT source_url, own, pos, row_number() OVER (ORDER BY pos) AS k FROM r WHERE sh IS NULL AND own NOT IN (SELECT slug FROM stored)),
  g AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS slugs, []::VARCHAR[] AS urls, false AS ins UNION ALL
    SELECT n, CASE WHEN ok THEN list_append(slugs, own) ELSE slugs END, CASE WHEN ok THEN list_append(urls, source_url) ELSE urls END, ok
    FROM (SELECT slugs, urls, f.k AS n, own, source_url, NOT list_contains(slugs, own) AND NOT list_contains(urls, source_url) AS ok FROM g JOIN f ON f.k = g.k + 1)),
  acc AS (SELECT f.source_url, f.pos AS came, f.own AS got FROM g JOIN f ON f.k = g.k WHERE ins)"""
_OUT = f"""{_BASE}, r AS (SELECT b.*, s.content_hash AS sh, s.slug AS ss, {T.SLUG_SQL.format('b.name')} AS own FROM batch b LEFT JOIN stored s ON s.source_url = b.source_url),
  {_GREEDY}, r2 AS (SELECT r.*, came, got, coalesce(lag(content_hash) OVER (PARTITION BY r.source_url ORDER BY pos), sh) AS before FROM r LEFT JOIN acc ON acc.source_url = r.source_url),
  done AS (SELECT *, coalesce(ss, CASE WHEN came IS NULL OR pos < came THEN own ELSE got END) AS slug, CASE WHEN sh IS NULL AND (came IS NULL OR pos < came) THEN 'rejected'
    WHEN sh IS NULL AND pos = came THEN 'inserted' WHEN before = content_hash THEN 'unchanged' ELSE 'updated' END AS outcome FROM r2)"""
_SNAP = f"""{_OUT}, l AS (SELECT source_url, bool_or(outcome <> 'unchanged') AS changed, arg_max({{'kind': kind, 'name': name, 'content_hash': content_hash, 'slug': slug}}, CASE WHEN outcome <> 'unchanged' THEN pos END) FILTER (outcome <> 'unchanged') AS n FROM done WHERE outcome <> 'rejected' GROUP BY 1),
  j AS (SELECT coalesce(s.source_url, l.source_url) AS url, s.* EXCLUDE (source_url), l.changed, coalesce(l.changed, false) AS new, l.changed IS NOT NULL AS seen, n FROM stored s FULL JOIN l ON l.source_url = s.source_url)"""
_CHUNKS = f"""{_OUT}, c AS (SELECT kind, id // 33 AS chunk, count(*) AS attempted, count(*) FILTER (outcome <> 'rejected') AS accepted, count(*) FILTER (outcome = 'rejected') AS rejected,
    (count(*) FILTER (outcome <> 'rejected') = 0)::INT AS failed_chunks FROM done GROUP BY 1, 2),
  e AS (SELECT kind, lpad(id::VARCHAR, 9, '0') || ': slug taken' AS e, row_number() OVER (PARTITION BY kind ORDER BY id) AS k FROM done WHERE outcome = 'rejected'),
  m AS (SELECT kind, sum(attempted)::BIGINT AS attempted, sum(accepted)::BIGINT AS accepted, sum(rejected)::BIGINT AS rejected, sum(failed_chunks)::BIGINT AS failed_chunks FROM c GROUP BY kind)"""
_WIRE = f"""WITH {T.CORPUS_SQL}, w AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'plugin' ELSE 'skill' END AS kind, CASE WHEN id % 41 = 0 THEN ' ' ELSE name END AS name,
  CASE WHEN id % 13 = 0 THEN 'javascript:alert(1)' WHEN id % 17 <> 0 THEN source_url END AS source_url, summary, description FROM corpus), issues AS (
  SELECT id AS index, 'kind' AS field, 'must be one of: {", ".join(KINDS)}' AS message FROM w WHERE kind = 'plugin'
  UNION ALL SELECT id, 'name', CASE WHEN trim(name) = '' THEN 'required non-empty string' ELSE 'exceeds 200 chars' END FROM w WHERE trim(name) = '' OR {U16_SQL.format('name')} > 200
  UNION ALL SELECT id, 'source_url', CASE WHEN source_url IS NULL THEN 'required string' ELSE 'must be an absolute http(s) URL' END FROM w WHERE source_url IS NULL OR source_url LIKE 'javascript%'
  UNION ALL SELECT id, 'summary', 'exceeds 300 chars; truncate upstream' FROM w WHERE {U16_SQL.format('summary')} > 300
  UNION ALL SELECT id, 'description', 'exceeds 4000 chars; truncate upstream' FROM w WHERE {U16_SQL.format('description')} > 4000
  UNION ALL SELECT id, 'tags', CASE WHEN id % 19 = 0 THEN 'must be an array of strings' WHEN id % 23 = 0 THEN 'exceeds 25 tags' ELSE 'all tags must be strings' END FROM w WHERE id % 19 = 0 OR id % 23 = 0 OR id % 29 = 0
  UNION ALL SELECT id, 'install_target', 'unknown target "' || t || '"' FROM w, (SELECT unnest(['emacs', 'vim']) AS t) WHERE id % 31 = 0
  UNION ALL SELECT id, 'install_target', 'must be an array' FROM w WHERE id % 37 = 0 AND id % 31 <> 0
  UNION ALL SELECT id, 'stars', 'must be a non-negative finite number' FROM w WHERE id % 43 = 0) """
_TOKENS = f"""WITH {T.CORPUS_SQL}, rows AS (SELECT id, name, summary, description, kind || ' ' || author AS tags, id % 7 <> 0 AS is_active, id % 13 AS quality_score FROM corpus),
  f AS (SELECT id, unnest(['name', 'summary', 'description', 'tags']) AS field, unnest([name, summary, description, tags]) AS t FROM rows),
  p AS (SELECT id, field, unnest(list_filter(regexp_split_to_array(strip_accents(lower(t)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS token FROM f)"""
_STEMMED = f"{_TOKENS}, {stem_sql.stems('p')}, q AS (SELECT id, field, stem AS token FROM p JOIN stems ON stems.token = p.token)"

QUERIES = {f.__name__: f for f in [upsert_outcomes, slug_collisions, ingest_report, upsert_snapshot, reactivation, chunk_ids, merge_outcomes, run_status, run_evidence, validation_issues, batch_verdict, exclusion_antijoin, fork_dedup, retired_reasons, fts_match, fts_unstemmed, fts_column_match, fts_page, fts_postings, fts_vocabulary, fts_scan]}

ORACLE = {
    "upsert_outcomes": _OUT + " SELECT id, outcome FROM done",
    "slug_collisions": _OUT + " SELECT id, source_url, slug FROM done WHERE outcome = 'rejected'",
    "ingest_report": _OUT + " SELECT kind, count(*) AS discovered, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome = 'rejected') AS rejected FROM done GROUP BY kind",
    "upsert_snapshot": _SNAP + """ SELECT url AS source_url, coalesce(slug, n.slug) AS slug, CASE WHEN new THEN n.kind ELSE kind END AS kind, sha256(CASE WHEN new THEN n.name ELSE name END) AS name_sha256, CASE WHEN new THEN n.content_hash ELSE content_hash END AS content_hash,
      CASE WHEN new THEN 0 ELSE quality_score END AS quality_score, CASE WHEN new THEN '' ELSE array_to_string(categories, ',') END AS categories, strftime(coalesce(first_seen_at, TIMESTAMP '2024-06-01'), '%Y-%m-%d') AS first_seen_at,
      strftime(CASE WHEN seen THEN TIMESTAMP '2024-06-01' ELSE last_seen_at END, '%Y-%m-%d') AS last_seen_at, CASE WHEN NOT new THEN strftime(enriched_at, '%Y-%m-%d') END AS enriched_at FROM j""",
    "reactivation": _SNAP + " SELECT url AS source_url, CASE WHEN seen THEN true ELSE is_active END AS is_active, CASE WHEN NOT seen THEN inactive_reason END AS inactive_reason FROM j",
    "chunk_ids": "SELECT doc_id AS id, doc_id // 33 AS chunk FROM documents",
    "merge_outcomes": _CHUNKS + " SELECT m.*, coalesce((SELECT string_agg(e, '|' ORDER BY k) FROM e WHERE e.kind = m.kind AND k <= 20), '') AS errors FROM m",
    "run_status": _CHUNKS + " SELECT kind, CASE WHEN accepted = 0 OR failed_chunks > 0 THEN 'failed' WHEN accepted < attempted THEN 'partial' ELSE 'ok' END AS status FROM m",
    "run_evidence": _CHUNKS + " SELECT 'crawler@' || kind AS agent, '2024-06-01T00:00:00Z' AS finished_at, CASE WHEN accepted = 0 OR failed_chunks > 0 THEN 'failed' WHEN accepted < attempted THEN 'partial' ELSE 'ok' END AS status, attempted AS discovered, accepted, rejected, least(rejected, 20) AS errors FROM m",
    "validation_issues": _WIRE + "SELECT index, field, message FROM issues",
    "batch_verdict": _WIRE + "SELECT b.batch, count(i.index) AS issues, count(i.index) = 0 AS accepted FROM (SELECT DISTINCT id // 10 AS batch FROM w) b LEFT JOIN issues i ON i.index // 10 = b.batch GROUP BY 1",
    "exclusion_antijoin": f"WITH {T.CORPUS_SQL} SELECT id, source_url FROM corpus WHERE source_url NOT IN (SELECT source_url FROM corpus WHERE id % 7 = 0)",
    "fork_dedup": f"WITH {T.CORPUS_SQL}, n AS (SELECT id, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY id % 50, (id * 7919) % 1000 DESC, id) AS k FROM corpus) SELECT id, content_hash FROM n WHERE k = 1",
    "retired_reasons": f"""WITH {T.CORPUS_SQL}, u AS (SELECT id, 'https://docs.example.com/at/' || id AS source_url, content_hash FROM corpus),
      k AS (SELECT source_url, row_number() OVER (PARTITION BY content_hash ORDER BY id) AS k FROM u WHERE id % 50 <> 7)
      SELECT source_url, 'removal_requested' AS reason FROM u WHERE id % 50 = 7 UNION ALL SELECT source_url, 'superseded' FROM k WHERE k > 1""",
    "fts_match": _STEMMED + " SELECT id, count(*) AS hits FROM q WHERE token IN ('the', 'right', 'reserv') GROUP BY id HAVING count(DISTINCT token) = 3",
    "fts_scan": _STEMMED + " SELECT id, count(*) AS hits FROM q WHERE token IN ('the', 'right', 'reserv') GROUP BY id HAVING count(DISTINCT token) = 3",
    "fts_unstemmed": _TOKENS + " SELECT id, count(*) AS hits FROM p WHERE token IN ('the', 'of') GROUP BY id HAVING count(DISTINCT token) = 2",
    "fts_column_match": _STEMMED + " SELECT id, count(*) AS hits FROM q WHERE token = 'the' AND field = 'name' GROUP BY id",
    "fts_page": _STEMMED + ", h AS (SELECT id, count(*) AS hits FROM q WHERE token = 'the' GROUP BY id) SELECT h.id, hits, quality_score, sha256(name) AS name_sha256 FROM h JOIN rows ON rows.id = h.id WHERE is_active ORDER BY hits DESC, quality_score DESC, h.id LIMIT 24 OFFSET 24",
    "fts_postings": _STEMMED + " SELECT field, token, count(*) AS n, count(DISTINCT id) AS docs FROM q GROUP BY 1, 2",
    "fts_vocabulary": _STEMMED + " SELECT token, stem FROM stems",
}
