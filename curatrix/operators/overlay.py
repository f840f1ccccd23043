"""The optional overlay of suggested texts: it may only add, and never touches a score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlay(rows: DataFrame, suggestions: DataFrame | None, id: str = "id") -> DataFrame:
    """``rows`` with a suggested summary, where there is one, and suggested tags behind their own.

    suggestions (id, summary, tags), one row per record at most; without any, all rows stay as they are.
    """
    if suggestions is None:
        return rows
    s = suggestions.select(id, F.col("summary").alias("_summary"), F.col("tags").alias("_tags"))
    none = F.array().cast("array<string>")
    summary = F.coalesce(F.nullif(F.trim("_summary"), F.lit("")), F.col("summary"))
    joined = rows.join(s, id, "left").withColumn("summary", summary)
    return joined.withColumn("tags", F.when(F.col("_tags").isNull(), F.col("tags")).otherwise(F.array_union(F.coalesce("tags", none), "_tags"))).select(*rows.columns)
