"""Recorded discovery feeds to wire records. Reads are native; each feed is a plan over recorded files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import documents
from curatrix.schemas import ARTIFACT_FIELDS, INGEST_BODY

#: Shapes of the recorded answers.
CODE_SEARCH = "total_count bigint, items array<struct<path:string, html_url:string, repository:struct<full_name:string, html_url:string>, score:double>>"
_SERVER = "struct<name:string, title:string, url:string, href:string, description:string, owner:string, repo:string, version:string, stars:bigint, tags:string, lastUpdated:string>"
REGISTRY = f"servers array<{_SERVER}>, items array<{_SERVER}>, nextCursor string, next_page_cursor string"
SKILL_FILE = "SKILL.md"


def filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def _wire(df: DataFrame, **values: Column) -> DataFrame:
    """Columns of the wire format; the ones that a feed lacks are null."""
    return df.select(*(values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in ARTIFACT_FIELDS))


def parsed(texts: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Answers or requests held as JSON text in a column, with the schema's columns beside the others."""
    return texts.withColumn("_json", F.from_json(column, schema)).select(*(c for c in texts.columns if c != column), "_json.*")


def encoded(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with array columns as JSON text, as the catalog stores them; null is the empty array."""
    return rows.withColumns({c: F.to_json(F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType))) for c in columns})


def decoded(rows: DataFrame, *columns: str) -> DataFrame:
    """The same columns as arrays of strings again; what is no JSON array is empty."""
    kind = "array<string>"
    return rows.withColumns({c: F.coalesce(F.from_json(c, kind), F.array().cast(kind)) for c in columns})


def search_query(locator: Column) -> Column:
    """owner/repo as a search for that repository's skill files; anything else is a query as it is."""
    return F.when(locator.rlike("^[^/\\s:]+/[^/\\s:]+$"), F.concat(F.lit("repo:"), locator, F.lit(f" filename:{SKILL_FILE}"))).otherwise(locator)


def _answers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def code_search(spark: SparkSession, path: str, contents: DataFrame | None = None) -> DataFrame:
    """Skill files of recorded code searches. contents (repo_full_name, content) gives the name in the frontmatter."""
    return code_search_records(_answers(spark, path, CODE_SEARCH), contents)


def code_search_records(answers: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """The same of parsed answers (CODE_SEARCH)."""
    items = answers.select(F.explode("items").alias("i")).filter(F.col("i.path") == SKILL_FILE)
    rows = items.select("i.html_url", F.col("i.repository.full_name").alias("repo_full_name"), F.col("i.repository.html_url").alias("homepage"))
    if contents is None:
        rows = rows.withColumn("content", F.lit(None).cast("string"))
    else:
        rows = rows.join(contents.select("repo_full_name", "content"), "repo_full_name", "left")
    field = lambda k: F.try_element_at(documents.frontmatter(F.col("content")), F.lit(k))
    repo = F.substring_index("repo_full_name", "/", -1)
    owner = F.substring_index("repo_full_name", "/", 1)
    return _wire(
        rows,
        kind=F.lit("skill"), name=filled(field("name"), repo), source_url=F.col("html_url"), summary=field("description"), repo_full_name=F.col("repo_full_name"),
        repo_host=F.lit("github.com"), homepage_url=F.col("homepage"), author=owner, tags=F.array().cast("array<string>"), install_target=F.array(F.lit("claude-code")),
    )


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Servers of recorded registry pages."""
    return registry_records(_answers(spark, path, REGISTRY))


def registry_records(answers: DataFrame) -> DataFrame:
    """The same of parsed answers (REGISTRY)."""
    s = answers.select(F.explode(F.coalesce("servers", "items")).alias("s")).select("s.*")
    tags = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    repo = F.when(filled(F.col("owner")).isNotNull() & filled(F.col("repo")).isNotNull(), F.concat_ws("/", "owner", "repo"))
    return _wire(
        s,
        kind=F.lit("mcp"), name=filled(F.col("name"), F.col("title"), F.lit("Unnamed MCP server")), source_url=F.coalesce(filled(F.col("url"), F.col("href")), F.lit("")),
        summary=F.col("description"), description=F.col("description"), repo_full_name=repo, author=F.col("owner"), tags=tags, install_target=F.array(F.lit("generic")),
        version=F.col("version"), stars=F.col("stars"), source_updated_at=F.col("lastUpdated"),
    )


def registry_cursor(spark: SparkSession, path: str) -> DataFrame:
    """Cursors to the pages after the recorded ones."""
    return _answers(spark, path, REGISTRY).select(filled(F.col("nextCursor"), F.col("next_page_cursor")).alias("cursor")).filter("cursor is not null")


def markdown_list(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Links of recorded markdown lists, in file and line order up to a limit."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    links = files.select("file", F.inline(documents.list_links(F.col("value"))))
    links = links.orderBy("file", "line").limit(limit) if limit is not None else links
    return _wire(links, kind=F.lit("skill"), name=F.trim("name"), source_url=F.trim("url"), tags=F.array().cast("array<string>"), install_target=F.array().cast("array<string>"))


def ingest_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Recorded ingest requests: agent, source_id and each record with its index."""
    return ingest_records(_answers(spark, path, INGEST_BODY).withColumn("request", F.input_file_name()))


def ingest_records(requests: DataFrame) -> DataFrame:
    """The records of parsed requests (request and INGEST_BODY)."""
    return requests.select("request", "agent", "source_id", F.posexplode("artifacts").alias("index", "a")).select("request", "agent", "source_id", "index", "a.*")


def with_defaults(records: DataFrame) -> DataFrame:
    """Wire records as rows: missing lists are empty, missing counts 0; empty texts stay."""
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("tags", "install_target")}
    return records.withColumns(lists | {c: F.coalesce(c, F.lit(0).cast(records.schema[c].dataType)) for c in ("stars", "forks")})


def allowed(records: DataFrame, robots: DataFrame) -> DataFrame:
    """Records whose host's robots rules allow their path. robots (host, content); a host without a file allows all."""
    u = F.col("source_url")
    host, path = F.regexp_extract(u, "^https?://([^/?#]+)", 1), F.regexp_extract(u, "^https?://[^/?#]+([^?#]*)", 1)
    rules = robots.select("host", documents.robots_rules(F.col("content")).alias("_rules"))
    joined = records.withColumn("host", host).join(rules, "host", "left")
    return joined.filter(documents.robots_allowed(F.col("_rules"), path)).select(*records.columns)


def harvest_report(entries: DataFrame) -> DataFrame:
    """Report totals of per-source entries (source, status, discovered, accepted, rejected, warnings)."""
    return entries.agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("status") == "failed").alias("failed"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("discovered", "accepted", "rejected")))
