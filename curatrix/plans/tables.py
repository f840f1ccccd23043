"""The driver's tables as the catalog's: which column plays which part, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.text import slugify

EVENTS_NOW = "2024-01-31 00:00:00"
ORDERS_NOW = "2001-08-02 00:00:00"

#: Part type to kind; one type has none.
KIND = {"STANDARD": "skill", "MEDIUM": "mcp", "PROMO": "ruleset", "LARGE": "subagent", "SMALL": "command"}
#: Tag, target and licence lists, picked by size and brand.
TAGS = [["CI", "Testing"], ["mcp", "server", "cli"], [], ["docs"], ["library", "api", "bin", "tool"]]
TARGETS = [["claude-code"], ["claude-desktop"], [], ["cursor", "zed"]]
LICENSES = ["MIT", "GPL-3.0", None, "NOASSERTION", "Apache-2.0"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index: Column) -> Column:
    kind = "array<string>" if any(isinstance(v, list) for v in values) else "string"
    made = [F.array(*map(F.lit, v)).cast(kind) if isinstance(v, list) else F.lit(v).cast(kind) for v in values]
    return F.get(F.array(*made), (index % len(values)).cast("int"))


def brand_number(brand: Column) -> Column:
    return F.regexp_extract(brand, "(\\d+)", 1).cast("int")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as artifacts."""
    p = read(spark, sf_dir, "part")
    kind = F.create_map(*(F.lit(x) for kv in KIND.items() for x in kv))[F.col("p_type")]
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        kind.alias("kind"),
        F.concat(F.lit("https://catalog.example.com/part/"), F.col("p_partkey").cast("string")).alias("source_url"),
        _pick(TAGS, size).alias("tags"),
        _pick(TARGETS, size).alias("install_target"),
        _pick(LICENSES, brand_number(F.col("p_brand"))).alias("license"),
        F.col("p_retailprice").alias("quality_score"),
        (size % 7 != 0).alias("is_active"),
        (size * 40).alias("stars"),
        (F.col("p_partkey") % 11).cast("long").alias("forks"),
    )


def _sql_list(values: list) -> str:
    one = lambda v: "NULL" if v is None else "'" + v + "'"
    return "[" + ", ".join("[" + ", ".join(map(one, v)) + "]::VARCHAR[]" if isinstance(v, list) else one(v) for v in values) + "]"


#: The same in SQL, for a WITH clause.
CATALOG_SQL = f"""catalog AS (
  SELECT p_partkey AS id, p_name AS name,
    CASE p_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KIND.items())} END AS kind,
    'https://catalog.example.com/part/' || p_partkey AS source_url,
    ({_sql_list(TAGS)})[p_size % {len(TAGS)} + 1] AS tags,
    ({_sql_list(TARGETS)})[p_size % {len(TARGETS)} + 1] AS install_target,
    ({_sql_list(LICENSES)})[regexp_extract(p_brand, '(\\d+)', 1)::INT % {len(LICENSES)} + 1] AS license,
    p_retailprice AS quality_score, p_size % 7 <> 0 AS is_active, p_size * 40 AS stars, p_partkey % 11 AS forks
  FROM part)"""


def checks(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    """``events`` as link observations; sparse: three observations of each record."""
    e = read(spark, sf_dir, "events")
    t, v = F.col("event_type"), F.col("value")
    status = F.when(t == "view", 200).when(t == "click", 301).when(t == "signup", 403).when(t == "purchase", 503).when(v > 250, 404).when(v < 2, None).otherwise(429)
    artifact = F.expr("event_id div 3") if sparse else F.col("user_id")
    return e.select(F.col("event_id").alias("id"), artifact.alias("artifact_id"), F.col("ts").alias("checked_at"), status.alias("http_status"))


def checks_sql(sparse: bool = False) -> str:
    artifact = "event_id // 3" if sparse else "user_id"
    return f"""checks AS (
  SELECT event_id AS id, {artifact} AS artifact_id, ts AS checked_at,
    CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 301 WHEN 'signup' THEN 403 WHEN 'purchase' THEN 503
      ELSE CASE WHEN value > 250 THEN 404 WHEN value < 2 THEN NULL ELSE 429 END END AS http_status
  FROM events)"""


#: Verdict of a status in SQL.
VERDICT_SQL = "CASE WHEN http_status >= 200 AND http_status < 400 THEN 'ok' WHEN http_status IN (404, 410) THEN 'terminal' ELSE 'transient' END"


def last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer as when a record was last seen."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_seen_at"))
    return o.withColumnRenamed("o_custkey", "artifact_id")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as runs of sources."""
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "ok").otherwise("partial")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), F.col("o_orderdate").alias("started_at"), status.alias("status"), F.floor("o_totalprice").alias("accepted"))


RUNS_SQL = """runs AS (
  SELECT o_orderkey AS id, o_custkey AS source_id, o_orderdate AS started_at,
    CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'ok' ELSE 'partial' END AS status,
    floor(o_totalprice)::BIGINT AS accepted
  FROM orders)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier`` as sources; the last run is the last event of the user with the same number, some have none."""
    last = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_run_at"))
    s = read(spark, sf_dir, "supplier")
    hours = (6 * (1 + F.col("s_suppkey") % 4)).cast("int")
    out = s.join(last, F.col("s_suppkey") == F.col("user_id"), "left")
    return out.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("locator"), (F.col("s_suppkey") % 5 != 0).alias("enabled"), hours.alias("cadence_hours"), F.when(F.col("s_suppkey") % 3 != 0, F.col("last_run_at")).alias("last_run_at"))


SOURCES_SQL = """sources AS (
  SELECT s_suppkey AS id, s_name AS locator, s_suppkey % 5 <> 0 AS enabled, 6 * (1 + s_suppkey % 4) AS cadence_hours,
    CASE WHEN s_suppkey % 3 <> 0 THEN m END AS last_run_at
  FROM supplier LEFT JOIN (SELECT user_id, max(ts) AS m FROM events GROUP BY user_id) ON user_id = s_suppkey)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as records of a batch."""
    d = read(spark, sf_dir, "documents")
    line = F.substring_index(F.col("text"), "\n", 1)
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("pos"),
        F.col("lang").alias("kind"),
        line.alias("name"),
        line.alias("summary"),
        F.col("text").alias("description"),
        F.concat(F.lit("https://docs.example.com/"), F.expr("doc_id div 2").cast("string")).alias("source_url"),
        F.sha2("text", 256).alias("content_hash"),
        F.col("source").alias("author"),
    )


CORPUS_SQL = """corpus AS (
  SELECT doc_id AS id, doc_id AS pos, lang AS kind, split_part(text, chr(10), 1) AS name, split_part(text, chr(10), 1) AS summary,
    text AS description, 'https://docs.example.com/' || (doc_id // 2) AS source_url, sha256(text) AS content_hash, source AS author
  FROM documents)"""

SLUG_SQL = "coalesce(nullif(left(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 120), ''), 'artifact')"


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog before the batch: the first record of two thirds of the addresses."""
    c = corpus(spark, sf_dir).filter("id % 2 = 0 AND id % 3 <> 0")
    old = F.lit("2024-01-01 00:00:00").cast("timestamp")
    # A stored slug carries the id, so that it is unique as the catalog demands.
    return c.select(
        "id", "kind", "name", F.concat(slugify(F.substring("name", 1, 40)), F.lit("-"), F.col("id").cast("string")).alias("slug"), "summary", "source_url", "author", "content_hash",
        (F.col("id") % 101).cast("int").alias("quality_score"), F.array("kind").alias("categories"), old.alias("first_seen_at"), old.alias("last_seen_at"), old.alias("enriched_at"),
        (F.col("id") % 5 != 0).alias("is_active"), F.when(F.col("id") % 5 == 0, "stale").alias("inactive_reason"),
    )


STORED_SQL = f"""stored AS (
  SELECT id, kind, name, {SLUG_SQL.format("left(name, 40)")} || '-' || id AS slug, summary, source_url, author, content_hash,
    id % 101 AS quality_score, [kind] AS categories, TIMESTAMP '2024-01-01 00:00:00' AS first_seen_at,
    TIMESTAMP '2024-01-01 00:00:00' AS last_seen_at, TIMESTAMP '2024-01-01 00:00:00' AS enriched_at,
    id % 5 <> 0 AS is_active, CASE WHEN id % 5 = 0 THEN 'stale' END AS inactive_reason
  FROM corpus WHERE id % 2 = 0 AND id % 3 <> 0)"""


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch: all documents, every tenth one altered; addresses come twice."""
    c = corpus(spark, sf_dir)
    altered = F.sha2(F.concat(F.col("description"), F.lit(" altered")), 256)
    return c.withColumn("content_hash", F.when(F.col("id") % 10 == 0, altered).when(F.col("id") % 4 == 1, F.lag("content_hash").over(_pairs())).otherwise(F.col("content_hash")))


def _pairs():
    from pyspark.sql.window import Window

    return Window.partitionBy("source_url").orderBy("pos")


BATCH_SQL = """batch AS (
  SELECT * REPLACE (CASE WHEN id % 10 = 0 THEN sha256(description || ' altered')
    WHEN id % 4 = 1 THEN lag(content_hash) OVER (PARTITION BY source_url ORDER BY pos) ELSE content_hash END AS content_hash)
  FROM corpus)"""
