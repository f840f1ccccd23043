"""One harvest over many sources: each source's records are written on their own, so a failure stays its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.url import is_safe_url
from curatrix.sources import feeds

ENTRY = "source string, adapter string, status string, discovered bigint, accepted bigint, rejected bigint, next_cursor string, error string"


@dataclass
class Context:
    """What an adapter gets besides its locator."""

    spark: SparkSession
    limit: int | None = None
    cursor: str | None = None
    options: dict = field(default_factory=dict)


#: An adapter: locator and context to wire records.
Adapter = Callable[[str, Context], DataFrame]

ADAPTERS: dict[str, Adapter] = {
    "code_search": lambda locator, c: feeds.code_search(c.spark, locator, c.options.get("contents")),
    "registry": lambda locator, c: feeds.registry(c.spark, locator),
    "markdown_list": lambda locator, c: feeds.markdown_list(c.spark, locator, c.limit),
}


def next_cursor(adapter: str, locator: str, context: Context) -> str | None:
    if adapter != "registry":
        return None
    row = feeds.registry_cursor(context.spark, locator).orderBy("cursor").first()
    return row["cursor"] if row else None


def run(sources: list[tuple[str, str, str]], out: str, context: Context, robots: DataFrame | None = None, adapters: dict[str, Adapter] | None = None) -> DataFrame:
    """Harvests (source, adapter, locator) triples into ``out``/source=... and returns the report's entries.

    An unknown adapter or an error makes a failed entry and stops no other source. Records without a safe address are
    rejected; robots (host, content) keeps denied paths out.
    """
    known = ADAPTERS if adapters is None else adapters
    entries = []
    for source, adapter, locator in sources:
        try:
            if adapter not in known:
                raise KeyError(f"unknown adapter {adapter}")
            found = known[adapter](locator, context)
            found = feeds.allowed(found, robots) if robots is not None else found
            found = found.limit(context.limit) if context.limit is not None else found
            path = f"{out}/source={source}"
            found.withColumn("safe", is_safe_url(F.col("source_url"))).write.mode("overwrite").partitionBy("safe").parquet(path)
            counts = {r["safe"]: r["n"] for r in context.spark.read.schema(found.schema.add("safe", "boolean")).parquet(path).groupBy("safe").agg(F.count(F.lit(1)).alias("n")).collect()}
            good, bad = counts.get(True, 0), counts.get(False, 0)
            entries.append((source, adapter, "partial" if bad else "ok", good + bad, good, bad, next_cursor(adapter, locator, context), None))
        except Exception as e:  # the report carries it
            entries.append((source, adapter, "failed", 0, 0, 0, None, str(e).strip().splitlines()[0][:300]))
    return context.spark.createDataFrame(entries, ENTRY)


def harvested(spark: SparkSession, out: str, schema) -> DataFrame:
    """Accepted records of a harvest, with their source."""
    return spark.read.schema(schema).parquet(out).filter("safe").drop("safe")
