"""Table schemas and their constraints as expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.taxonomy import KINDS


# Schemas are DDL text, which every reader takes and which needs no session.
ARTIFACT = (
    "kind string, name string, source_url string, summary string, description string, repo_full_name string, repo_host string, homepage_url string, "
    "license string, author string, tags array<string>, install_target array<string>, version string, stars double, forks double, source_updated_at string"
)
INGEST_BODY = "agent string, source_id bigint, artifacts array<struct<" + ", ".join(f.replace(" ", ": ") for f in ARTIFACT.split(", ")) + ">>"
#: (name, type) of each wire column.
ARTIFACT_FIELDS = [tuple(f.split(" ")) for f in ARTIFACT.split(", ")]
ARTIFACTS = (
    "id bigint, name string, slug string, kind string, summary string, description string, source_url string, repo_full_name string, repo_host string, homepage_url string, "
    "license string, author string, tags array<string>, categories array<string>, install_target array<string>, version string, stars bigint, forks bigint, quality_score int, "
    "quality_breakdown struct<metadata:int,documentation:int,freshness:int,licensing:int,popularity:int,discoverability:int>, content_hash string, first_seen_at timestamp, "
    "last_seen_at timestamp, source_updated_at timestamp, enriched_at timestamp, is_active boolean, inactive_reason string"
)
SOURCES = (
    "id bigint, adapter string, locator string, kind string, enabled boolean, cadence_hours int, last_run_at timestamp, last_cursor string, consecutive_failures int, health string, notes string, created_at timestamp"
)
SOURCE_RUNS = (
    "id bigint, source_id bigint, agent string, started_at timestamp, finished_at timestamp, status string, discovered bigint, accepted bigint, rejected bigint, errors array<string>"
)
CHECKS = "id bigint, artifact_id bigint, checked_at timestamp, http_status int, ok boolean, latency_ms bigint, reason string"
CATEGORIES = "id bigint, slug string, label string, kind string, description string, artifact_count bigint, updated_at timestamp"
CLICKS = "id bigint, artifact_id bigint, clicked_at timestamp, referer_host string"
POSTINGS = "field string, token string, id bigint, pos int"

#: Allowed states.
HEALTH = ["unknown", "healthy", "degraded", "failing"]
RUN_STATUS = ["ok", "partial", "failed"]


def expectations(table: str) -> dict:
    """Constraints of a table by name; built when asked for, as expressions need a session."""
    return {
        "artifacts": {"kind": F.col("kind").isin(KINDS), "inactive needs a reason": F.col("is_active") | F.col("inactive_reason").isNotNull()},
        "sources": {"health": F.col("health").isin(HEALTH), "cadence": F.col("cadence_hours") > 0},
        "source_runs": {"status": F.col("status").isin(RUN_STATUS)},
    }.get(table, {})


def violations(df: DataFrame, table: str) -> DataFrame:
    """One row (constraint, rows) for each constraint, with the number of rows that break it."""
    counts = {name: F.count_if(~F.coalesce(rule, F.lit(False))) for name, rule in expectations(table).items()}
    pairs = F.array(*(F.struct(F.lit(n).alias("constraint"), c.alias("rows")) for n, c in counts.items()))
    return df.agg(pairs.alias("p")).select(F.inline("p"))
