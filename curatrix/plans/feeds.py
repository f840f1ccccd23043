"""Queries of the discovery feeds: answers and requests are made of the driver's tables as JSON text and parsed again."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.plans import tables as T
from curatrix.schemas import INGEST_BODY
from curatrix.sources import feeds


def _search_answers(spark, sf):
    """``pages`` as answers of a code search, some of whose files have another name."""
    p = T.read(spark, sf, "pages")
    i = F.col("page_id")
    repo = F.concat(F.lit("o"), (i % 7).cast("string"), F.lit("/r"), i.cast("string"))
    at = lambda x: F.concat(F.lit("https://host.example/"), x)
    item = F.struct(F.when(i % 3 == 0, F.lit("docs/SKILL.md")).otherwise(F.lit("SKILL.md")).alias("path"), F.col("url").alias("html_url"), F.struct(repo.alias("full_name"), at(repo).alias("html_url")).alias("repository"))
    texts = p.groupBy(F.expr("page_id div 100").alias("answer")).agg(F.collect_list(item).alias("items"))
    return feeds.parsed(texts.select(F.to_json(F.struct("items")).alias("value")), feeds.CODE_SEARCH)


def code_search_feed(spark, sf):
    i = F.col("page_id")
    repo = F.concat(F.lit("o"), (i % 7).cast("string"), F.lit("/r"), i.cast("string"))
    content = F.concat(F.lit("---\nname: skill "), i.cast("string"), F.lit("\ndescription: 'd "), i.cast("string"), F.lit("'\n---\n"))
    contents = T.read(spark, sf, "pages").filter("page_id % 2 = 0").select(repo.alias("repo_full_name"), content.alias("content"))
    out = feeds.code_search_records(_search_answers(spark, sf), contents)
    return out.select("kind", "name", "source_url", "summary", "repo_full_name", "repo_host", "homepage_url", "author", F.to_json("install_target").alias("install_target"))


def search_queries(spark, sf):
    s = T.read(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("owner/repo-"), F.col("s_suppkey").cast("string"))).otherwise(F.concat(F.lit("path:skills "), F.col("s_name"))).alias("locator"))
    return s.select("s_suppkey", feeds.search_query(F.col("locator")).alias("query"))


def registry_feed(spark, sf):
    """``part`` as pages of a registry, in both of its shapes."""
    p = T.read(spark, sf, "part")
    i = F.col("p_partkey")
    text = i.cast("string")
    server = F.struct(
        F.when(i % 2 == 0, F.col("p_name")).otherwise(F.lit("")).alias("name"), F.when(i % 3 == 0, F.concat(F.lit("T"), text)).alias("title"),
        F.when(i % 4 != 0, F.concat(F.lit("https://s.example/"), text)).alias("url"), F.when(i % 8 != 0, F.concat(F.lit("https://h.example/"), text)).alias("href"),
        F.lit("o").alias("owner"), F.when(i % 5 != 0, F.concat(F.lit("r"), text)).alias("repo"), F.lit("a, ,b c,").alias("tags"), F.col("p_size").alias("stars"),
    )
    pages = p.groupBy(F.expr("p_partkey div 50").alias("page")).agg(F.collect_list(server).alias("all"))
    first = F.to_json(F.struct(F.col("all").alias("servers"), F.concat(F.lit("c"), F.col("page").cast("string")).alias("nextCursor")))
    answers = feeds.parsed(pages.select(F.when(F.col("page") % 2 == 0, first).otherwise(F.to_json(F.struct(F.col("all").alias("items")))).alias("value")), feeds.REGISTRY)
    return feeds.registry_records(answers).select("kind", "name", "source_url", "repo_full_name", "author", F.array_join("tags", "|").alias("tags"), F.col("stars").cast("long").alias("stars"))


def ingest_bodies(spark, sf):
    """``supplier`` as requests; a missing list or count has its default, an empty text stays."""
    s = T.read(spark, sf, "supplier")
    i = F.col("s_suppkey")
    record = F.struct(
        F.lit("skill").alias("kind"), F.col("s_name").alias("name"), F.concat(F.lit("https://x.example/"), i.cast("string")).alias("source_url"),
        F.when(i % 2 == 0, F.lit("")).alias("summary"), F.when(i % 3 == 0, F.array(F.lit("t"), F.col("s_name"))).alias("tags"), F.when(i % 5 != 0, i).alias("stars"),
    )
    requests = s.groupBy((i % 10).alias("request")).agg(F.array_sort(F.collect_list(record)).alias("artifacts"))
    body = F.to_json(F.struct(F.lit("crawler").alias("agent"), F.col("request").alias("source_id"), "artifacts"))
    rows = feeds.with_defaults(feeds.ingest_records(feeds.parsed(requests.select("request", body.alias("value")), INGEST_BODY)))
    stored = feeds.decoded(feeds.encoded(rows, "tags"), "tags")
    return stored.select("agent", F.col("source_id").cast("long").alias("source_id"), "index", "name", "source_url", "summary", F.array_join("tags", "|").alias("tags"), F.col("stars").cast("long").alias("stars"))


def harvest_report(spark, sf):
    """Totals over the entries of a harvest, here the runs of one day."""
    r = T.runs(spark, sf).withColumn("accepted", F.col("accepted").cast("long")).withColumn("rejected", F.col("id") % 3)
    entries = r.select(F.col("source_id").cast("string").alias("source"), "status", (F.col("accepted") + F.col("rejected")).alias("discovered"), "accepted", "rejected")
    return feeds.harvest_report(entries)


QUERIES = {f.__name__: f for f in [code_search_feed, search_queries, registry_feed, ingest_bodies, harvest_report]}

_REPO = "'o' || page_id % 7 || '/r' || page_id"

ORACLE = {
    "code_search_feed": f"""SELECT 'skill' AS kind, CASE WHEN page_id % 2 = 0 THEN 'skill ' || page_id ELSE 'r' || page_id END AS name, url AS source_url, CASE WHEN page_id % 2 = 0 THEN 'd ' || page_id END AS summary,
      {_REPO} AS repo_full_name, 'github.com' AS repo_host, 'https://host.example/' || {_REPO} AS homepage_url, 'o' || page_id % 7 AS author, '["claude-code"]' AS install_target FROM pages WHERE page_id % 3 <> 0""",
    "search_queries": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'repo:owner/repo-' || s_suppkey || ' filename:SKILL.md' ELSE 'path:skills ' || s_name END AS query FROM supplier",
    "registry_feed": """SELECT 'mcp' AS kind, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN 'T' || p_partkey ELSE 'Unnamed MCP server' END AS name,
      CASE WHEN p_partkey % 4 <> 0 THEN 'https://s.example/' || p_partkey WHEN p_partkey % 8 <> 0 THEN 'https://h.example/' || p_partkey ELSE '' END AS source_url,
      CASE WHEN p_partkey % 5 <> 0 THEN 'o/r' || p_partkey END AS repo_full_name, 'o' AS author, 'a|b c' AS tags, p_size::BIGINT AS stars FROM part""",
    "ingest_bodies": """SELECT 'crawler' AS agent, (s_suppkey % 10)::BIGINT AS source_id, row_number() OVER (PARTITION BY s_suppkey % 10 ORDER BY s_name) - 1 AS index, s_name AS name, 'https://x.example/' || s_suppkey AS source_url,
      CASE WHEN s_suppkey % 2 = 0 THEN '' END AS summary, CASE WHEN s_suppkey % 3 = 0 THEN 't|' || s_name ELSE '' END AS tags, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey ELSE 0 END::BIGINT AS stars FROM supplier""",
    "harvest_report": f"WITH {T.RUNS_SQL} SELECT count(*) AS sources, count(*) FILTER (status = 'failed') AS failed, sum(accepted + id % 3)::BIGINT AS discovered, sum(accepted)::BIGINT AS accepted, sum(id % 3)::BIGINT AS rejected FROM runs",
}
