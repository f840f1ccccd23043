"""Queries of the scorer and the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import dates, documents, hashing, score, text, url
from curatrix.plans import tables as T

SPACE_SQL = r"[\s\x{000b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
NORM_SQL = "trim(regexp_replace(coalesce({0}, ''), '" + SPACE_SQL.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'))"
#: UTF-16 length: characters beyond the base plane count twice.
U16_SQL = r"(length({0}) + length(regexp_replace({0}, '[^\x{{10000}}-\x{{10ffff}}]', '', 'g')))"


def normalize_text(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", F.sha2(text.normalize_text(F.col("text")), 256).alias("normalized_sha256"))


def normalize_url(spark, sf):
    return T.read(spark, sf, "pages").select("page_id", url.normalize_url(F.col("url")).alias("url"))


#: What stands in front of the path, and behind the address, by page: detours that lead back, and parameters as they may come.
_DETOURS = ["/./", "/x/../", "/x/y/%2E%2e/.%2e/", "/../", "/a b/é/../%7e%zz/"]
_ADDED = ["q=a%20b&B=~*", "b&a=1+2&A=%3d", "c=%C3%A9&utm_term=x", "=&%72ef=1"]


def url_normal_form(spark, sf):
    p = T.read(spark, sf, "pages")
    pick = lambda xs, i: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.pmod(i, F.lit(len(xs))) + 1).cast("int"))
    bare = F.regexp_extract("url", "^(https?://[^/?#]+)(/[^?#]*)", 0)
    path = F.regexp_extract("url", "^(https?://[^/?#]+)/([^?#]*)", 2)
    odd = F.concat(F.upper(F.regexp_extract("url", "^(https?://[^/?#]+)", 1)), pick(_DETOURS, F.col("page_id")), path, F.lit("?"), pick(_ADDED, F.col("page_id")), F.lit("#x"))
    return p.filter(bare != "").select("page_id", url.normalize_url(odd).alias("url"))


def safe_url(spark, sf):
    p = T.read(spark, sf, "pages")
    odd = F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", "^https?:", "ftp:")).when(F.col("page_id") % 5 == 1, F.regexp_replace("url", "^https?:", "")).otherwise(F.col("url"))
    return p.select("page_id", url.is_safe_url(odd).alias("safe"))


def content_hash(spark, sf):
    p = T.read(spark, sf, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    tags = F.array(F.lit("web"), F.lit(" b  a "), F.lit(" "))
    return p.select("page_id", hashing.content_hash(F.lit("skill"), title, F.lit(None).cast("string"), F.col("url"), F.lit("MIT"), tags).alias("content_hash"))


def slugify(spark, sf):
    return T.corpus(spark, sf).select("id", text.slugify(F.col("name")).alias("slug"))


def days_since(spark, sf):
    o = T.read(spark, sf, "orders")
    return o.select("o_orderkey", dates.days_since(F.col("o_orderdate"), "2000-01-01 12:00:00").alias("days"))


def iso_format(spark, sf):
    return T.read(spark, sf, "events").select("event_id", dates.iso(F.col("ts")).alias("iso"))


def is_stale(spark, sf):
    c = T.read(spark, sf, "customer").select(F.col("c_custkey").alias("artifact_id")).join(T.last_seen(spark, sf), "artifact_id", "left")
    return c.select("artifact_id", dates.is_stale(F.col("last_seen_at"), 180, T.ORDERS_NOW).alias("stale"))


def is_expired(spark, sf):
    o = T.read(spark, sf, "orders")
    raw = F.when(F.col("o_orderkey") % 10 == 0, F.lit("not a date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return o.select("o_orderkey", dates.is_expired(raw, "2000-01-01 00:00:00").alias("expired"))


def _scored(spark, sf):
    """documents as records: labels give the flags, events of the user with the same number the stars."""
    d = T.corpus(spark, sf).join(T.read(spark, sf, "labels").withColumnRenamed("doc_id", "id"), "id", "left")
    stars = T.read(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("stars"))
    d = d.join(stars, "id", "left")
    i = F.col("id")
    return d.withColumns({
        "frontmatter": F.coalesce(F.col("quality") == 1, F.lit(False)),
        "readme": i % 3 == 0,
        "examples": F.coalesce(F.col("toxic") == 0, F.lit(False)),
        "tags": F.transform(F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")), F.lit(1), (i % 5).cast("int")), lambda x: x),
        "targets": F.slice(F.array(F.lit("cursor")), F.lit(1), (i % 2).cast("int")),
        "days": F.when(i % 9 != 0, (i * 7) % 900),
        "license": T._pick(T.LICENSES, i),
    })


def _score_struct():
    c = F.col
    return score.breakdown(c("frontmatter"), c("summary"), c("tags"), c("targets"), c("readme"), c("examples"), c("description"), c("days"), c("license"), c("stars"))


def quality_score(spark, sf):
    return _scored(spark, sf).select("id", _score_struct().alias("s")).select("id", "s.*")


def quality_notes(spark, sf):
    c = F.col
    n = score.notes(c("frontmatter"), c("summary"), c("readme"), c("examples"), c("days"), c("license"))
    return _scored(spark, sf).select("id", F.array_join(n, "|").alias("notes"))


def score_bands(spark, sf):
    return _scored(spark, sf).select(score.band(_score_struct()["score"]).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def curate(spark, sf):
    """Score and categories of the queue's records in one pass."""
    from curatrix.functions import taxonomy
    from curatrix.operators import browse

    c = T.catalog(spark, sf).withColumn("enriched_at", F.when(F.col("id") % 3 == 0, F.lit(1))).withColumn("last_seen_at", F.col("stars"))
    q = browse.enrich_queue(c)
    s = score.breakdown(F.lit(True), F.col("name"), F.col("tags"), F.col("install_target"), F.lit(False), F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.col("license"), F.col("stars"))
    return q.select("id", s["score"].alias("score"), F.array_join(taxonomy.map_categories(F.col("kind"), F.col("tags"), F.col("install_target")), ",").alias("categories"))


def has_examples(spark, sf):
    d = T.read(spark, sf, "documents")
    shown = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\n## Usage\nrun"))).when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("\n```\ncode\n```"))).otherwise(F.col("text"))
    return d.select("doc_id", text.has_examples(shown).alias("has_examples"))


def frontmatter(spark, sf):
    d = T.read(spark, sf, "documents")
    head = F.regexp_replace(F.substring(F.substring_index("text", "\n", 1), 1, 60), "[:\"']", "")
    content = F.concat(F.lit("---\nname: doc-"), F.col("doc_id").cast("string"), F.lit("\ndescription: \""), head, F.lit("\"\nname: 'last-"), F.col("doc_id").cast("string"), F.lit("'\n---\n"), F.col("text"))
    content = F.when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(content)
    m = documents.frontmatter(content)
    return d.select("doc_id", F.try_element_at(m, F.lit("name")).alias("name"), F.sha2(F.try_element_at(m, F.lit("description")), 256).alias("description_sha256"), documents.frontmatter_valid(m).alias("valid"))


def markdown_links(spark, sf):
    p = T.read(spark, sf, "pages")
    made = lambda label, u: F.concat(F.lit(f"- [{label}]("), u, F.lit(")\n"))
    content = F.concat(F.lit("# List\n"), made("page", F.col("url")), made("badge", F.lit("https://img.shields.io/badge/x.svg")), made("anchor", F.lit("top")), F.lit("text\n"), made("again", F.concat(F.col("url"), F.lit("/more"))))
    return p.select("page_id", F.inline(documents.list_links(content)))


def robots_gate(spark, sf):
    p = T.read(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1).alias("path"))
    hosts = p.groupBy("host").agg(F.min("path").alias("denied"), F.max("path").alias("allowed"))
    # Rules before any agent and those of an earlier group do not count.
    content = F.concat(F.lit("Allow: /\nCrawl-delay: 9\nUser-agent: other\nDisallow: /\n# Disallow: /\n\nUser-agent: *  # all\nDisallow: "), F.col("denied"), F.lit("\nAllow: "), F.col("allowed"), F.lit("\ncrawl-delay: 2.5\nCrawl-delay: soon\n"))
    rules = hosts.select("host", documents.robots_rules(content).alias("rules"))
    ok = p.join(rules, "host", "left").filter(documents.robots_allowed(F.col("rules"), F.col("path")))
    return ok.select("page_id", "host", "path", F.col("rules.crawl_delay").alias("crawl_delay"))


def fetch_backoff(spark, sf):
    e = T.read(spark, sf, "events").select("event_id", (F.col("event_id") % 10 + 1).alias("attempt"))
    return e.select("event_id", F.least(F.lit(500) * F.pow(F.lit(2), F.col("attempt") - 1), F.lit(30_000)).cast("long").alias("backoff_ms"))


_PERMISSIVE = ", ".join(f"'{x}'" for x in score.PERMISSIVE)
_LICENSES = "(['MIT', 'GPL-3.0', NULL, 'NOASSERTION', 'Apache-2.0'])[(id % 5 + 1)::INT]"
_SCORED = f"""WITH {T.CORPUS_SQL}, stars AS (SELECT user_id, count(*) AS stars FROM events GROUP BY user_id),
  base AS (SELECT c.*, coalesce(l.quality = 1, false) AS frontmatter, id % 3 = 0 AS readme, coalesce(l.toxic = 0, false) AS examples,
    id % 5 AS n_tags, id % 2 AS n_targets, CASE WHEN id % 9 <> 0 THEN (id * 7) % 900 END AS days, {_LICENSES} AS license, s.stars,
    {U16_SQL.format("trim(summary)")} AS ls, {U16_SQL.format("trim(description)")} AS ld
    FROM corpus c LEFT JOIN labels l ON l.doc_id = c.id LEFT JOIN stars s ON s.user_id = c.id),
  parts AS (SELECT *,
    (CASE WHEN frontmatter THEN 12 ELSE 0 END + CASE WHEN ls >= 40 THEN 7 WHEN ls > 0 THEN 3 ELSE 0 END + CASE WHEN n_tags >= 3 THEN 4 WHEN n_tags > 0 THEN 2 ELSE 0 END + CASE WHEN n_targets > 0 THEN 2 ELSE 0 END) AS metadata,
    (CASE WHEN readme THEN 10 ELSE 0 END + CASE WHEN examples THEN 8 ELSE 0 END + CASE WHEN ld >= 800 THEN 7 WHEN ld >= 250 THEN 4 WHEN ld > 0 THEN 2 ELSE 0 END) AS documentation,
    (CASE WHEN days IS NULL THEN 4 WHEN days <= 30 THEN 20 WHEN days <= 365 THEN round(20 - ((days - 30) / 335.0::DOUBLE) * 15)::INT WHEN days <= 730 THEN 3 ELSE 0 END) AS freshness,
    (CASE WHEN license IN ({_PERMISSIVE}) THEN 10 WHEN license IS NOT NULL AND license <> 'NOASSERTION' THEN 6 ELSE 0 END) AS licensing,
    least(round(log10(coalesce(stars, 0) + 1) * 5)::INT, 20) AS popularity FROM base),
  scored AS (SELECT *, metadata + documentation + freshness + licensing + popularity AS score FROM parts) """
_URL = r"^(?i)(https?)://([^/?#\s]+)([^?#\s]*)(\?[^#\s]*)?(#.*)?$"
_URL_DUCK = _URL.replace("^(?i)", "(?i)^")
_X = lambda i, u="u": f"regexp_extract({u}, '{_URL_DUCK}', {i})"
#: A parameter decoded and encoded as forms do it.
_FORM = "replace(replace(replace(url_encode(url_decode(replace({0}, '+', ' '))), '%20', '+'), '~', '%7E'), '%2A', '*')"
_NORM_URL = f"""parsed AS (SELECT *, lower({_X(1)}) AS scheme, regexp_replace(lower({_X(2)}), CASE WHEN lower({_X(1)}) = 'https' THEN ':443$' ELSE ':80$' END, '') AS host,
    CASE WHEN {_X(3)} = '' THEN '/' ELSE {_X(3)} END AS path0,
    list_filter(string_split(substr({_X(4)}, 2), '&'), lambda p: p <> '' AND NOT regexp_full_match(split_part(p, '=', 1), '(?i)(utm_.*|ref|referrer|source|gclid|fbclid)')) AS pairs FROM raw),
  sorted AS (SELECT *, array_to_string(list_transform(list_sort(list_transform(pairs, lambda p, i: {{'k': split_part(p, '=', 1), 'i': i, 'p': p}})), lambda x: {_FORM.format("x.k")} || '=' || {_FORM.format("substr(x.p, length(x.k) + 2)")}), '&') AS query FROM parsed),
  cut AS (SELECT *, CASE WHEN query = '' AND length(path0) > 1 THEN regexp_replace(path0, '/$', '') ELSE path0 END AS path FROM sorted),
  canonical AS (SELECT *, CASE WHEN regexp_matches(u, '{_URL_DUCK}') THEN scheme || '://' || host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END ELSE u END AS url2 FROM cut)"""
_RAW = "raw AS (SELECT page_id, html, trim(url) AS u FROM pages)"
_ODD = "CASE page_id % 5 WHEN 0 THEN regexp_replace(url, '^https?:', 'ftp:') WHEN 1 THEN regexp_replace(url, '^https?:', '') ELSE url END"

QUERIES = {f.__name__: f for f in [normalize_text, normalize_url, url_normal_form, safe_url, content_hash, slugify, days_since, iso_format, is_stale, is_expired, quality_score, quality_notes, score_bands, curate, has_examples, frontmatter, markdown_links, robots_gate, fetch_backoff]}

ORACLE = {
    "normalize_text": f"SELECT doc_id, sha256({NORM_SQL.format('text')}) AS normalized_sha256 FROM documents",
    "normalize_url": f"WITH {_RAW}, {_NORM_URL} SELECT page_id, url2 AS url FROM canonical",
    # Written from what the detours and parameters are known to come to, not by reducing them.
    "url_normal_form": """SELECT page_id, lower(regexp_extract(url, '^https?://[^/?#]+')) || ['/', '/', '/', '/', '/a%20b/%7e%zz/'][(page_id % 5)::INT + 1] || regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1)
      || ['?B=%7E*&q=a+b', '?a=1+2&A=%3D&b=', '?c=%C3%A9', '?='][(page_id % 4)::INT + 1] AS url FROM pages WHERE regexp_matches(url, '^https?://[^/?#]+/')""",
    "safe_url": f"SELECT page_id, regexp_matches({_ODD}, '(?i)^https?://[^/?#\\s]+') AS safe FROM pages",
    "content_hash": f"WITH {_RAW}, {_NORM_URL} SELECT page_id, sha256(concat_ws(chr(0), 'skill', {NORM_SQL.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '', url2, 'MIT', 'b a,web')) AS content_hash FROM canonical",
    "slugify": f"WITH {T.CORPUS_SQL} SELECT id, {T.SLUG_SQL.format('name')} AS slug FROM corpus",
    "days_since": "SELECT o_orderkey, greatest(floor((epoch_us(TIMESTAMP '2000-01-01 12:00:00') - epoch_us(o_orderdate)) / 86400000000.0), 0)::BIGINT AS days FROM orders",
    "iso_format": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events",
    "is_stale": "SELECT c_custkey AS artifact_id, coalesce(TIMESTAMP '2001-08-02 00:00:00' - m > INTERVAL 180 DAY, true) AS stale FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "is_expired": "SELECT o_orderkey, o_orderkey % 10 = 0 OR o_orderdate <= TIMESTAMP '2000-01-01 00:00:00' AS expired FROM orders",
    "quality_score": _SCORED + "SELECT id, score, metadata, documentation, freshness, licensing, popularity, 0 AS discoverability FROM scored",
    "quality_notes": _SCORED + f"""SELECT id, array_to_string(list_filter([CASE WHEN NOT frontmatter THEN 'No valid frontmatter detected.' END, CASE WHEN ls = 0 THEN 'Missing a description/summary.' END,
      CASE WHEN NOT readme THEN 'No README found.' END, CASE WHEN NOT examples THEN 'No usage examples detected.' END,
      CASE WHEN days IS NULL THEN 'Upstream last-modified date unknown.' WHEN days > 730 THEN 'Not updated in over two years.' WHEN days > 365 THEN 'Not updated in over a year.' END,
      CASE WHEN license IS NULL OR license = 'NOASSERTION' THEN 'No license declared — reuse rights are unclear.' WHEN license NOT IN ({_PERMISSIVE}) THEN 'License "' || license || '" may restrict reuse.' END], lambda x: x IS NOT NULL), '|') AS notes FROM scored""",
    "score_bands": _SCORED + "SELECT CASE WHEN score >= 80 THEN 'well maintained' WHEN score >= 60 THEN 'solid' WHEN score >= 40 THEN 'usable' WHEN score >= 20 THEN 'gaps' ELSE 'barely described' END AS band, count(*) AS n FROM scored GROUP BY 1",
    "has_examples": "SELECT doc_id, coalesce(doc_id % 4 IN (0, 1) OR contains(text, '```') OR contains(text, 'examples/') OR regexp_matches(text, '(?mi)^##\\s+usage'), false) AS has_examples FROM documents",
    "frontmatter": r"""SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN 'last-' || doc_id END AS name, CASE WHEN doc_id % 7 <> 0 THEN sha256(regexp_replace(left(split_part(text, chr(10), 1), 60), '[:"'']', '', 'g')) END AS description_sha256,
      doc_id % 7 <> 0 AND regexp_replace(left(split_part(text, chr(10), 1), 60), '[:"'']', '', 'g') <> '' AS valid FROM documents""",
    "markdown_links": "SELECT page_id, 1 AS line, 'page' AS name, url FROM pages WHERE NOT regexp_matches(url, 'badge|img') UNION ALL SELECT page_id, 5, 'again', url || '/more' FROM pages WHERE NOT regexp_matches(url, 'badge|img')",
    "robots_gate": """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages),
      r AS (SELECT host, min(path) AS denied, max(path) AS allowed FROM p GROUP BY host)
      SELECT page_id, p.host, path, 2.5::DOUBLE AS crawl_delay FROM p JOIN r ON r.host = p.host WHERE path = allowed OR allowed = '/' OR NOT (path = denied OR denied = '/')""",
    "fetch_backoff": "SELECT event_id, least(500 * 2 ** (event_id % 10), 30000)::BIGINT AS backoff_ms FROM events",
}
from curatrix.plans import browse as _b  # noqa: E402

ORACLE["curate"] = f"""{_b.WITH}, {_b._CATS}, queue AS (SELECT * FROM categorized WHERE is_active AND id % 3 <> 0 ORDER BY stars DESC, id LIMIT 100)
  SELECT id, least(12 + CASE WHEN length(name) >= 40 THEN 7 WHEN length(name) > 0 THEN 3 ELSE 0 END + CASE WHEN len(tags) >= 3 THEN 4 WHEN len(tags) > 0 THEN 2 ELSE 0 END + CASE WHEN len(install_target) > 0 THEN 2 ELSE 0 END, 25) + 4
    + CASE WHEN license IN ({_PERMISSIVE}) THEN 10 WHEN license IS NOT NULL AND license <> 'NOASSERTION' THEN 6 ELSE 0 END + least(round(log10(stars + 1) * 5)::INT, 20) AS score,
    array_to_string(categories, ',') AS categories FROM queue"""
