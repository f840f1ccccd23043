"""Whole-batch validation: every issue of every record, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.taxonomy import KINDS, TARGETS
from curatrix.functions.text import JS_SPACE, utf16_length
from curatrix.functions.url import is_safe_url

#: Limits of the wire format.
MAX_NAME, MAX_SUMMARY, MAX_DESCRIPTION, MAX_TAGS, MAX_BATCH = 200, 300, 4000, 25, 500


def _blank(text: Column) -> Column:
    return text.isNull() | (F.regexp_replace(text, JS_SPACE, "") == "")


def issues(kind: Column, name: Column, url: Column, summary: Column, description: Column, tags: Column, targets: Column, stars: Column, forks: Column) -> Column:
    """Array of (field, message) of one record."""
    say = lambda field, message: F.struct(F.lit(field).alias("field"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))
    number = lambda n: n.isNotNull() & (F.isnan(n.cast("double")) | (F.abs(n.cast("double")) == float("inf")) | (n < 0))
    unknown = F.transform(
        F.filter(F.coalesce(targets, F.array().cast("array<string>")), lambda t: ~F.coalesce(t.isin(TARGETS), F.lit(False))),
        lambda t: say("install_target", F.concat(F.lit('unknown target "'), F.coalesce(t, F.lit("null")), F.lit('"'))),
    )
    first = [
        F.when(~F.coalesce(kind.isin(KINDS), F.lit(False)), say("kind", "must be one of: " + ", ".join(KINDS))),
        F.when(_blank(name), say("name", "required non-empty string")).when(utf16_length(name) > MAX_NAME, say("name", f"exceeds {MAX_NAME} chars")),
        F.when(url.isNull(), say("source_url", "required string")).when(~is_safe_url(url), say("source_url", "must be an absolute http(s) URL")),
        F.when(utf16_length(summary) > MAX_SUMMARY, say("summary", f"exceeds {MAX_SUMMARY} chars; truncate upstream")),
        F.when(utf16_length(description) > MAX_DESCRIPTION, say("description", f"exceeds {MAX_DESCRIPTION} chars; truncate upstream")),
        F.when(tags.isNull(), say("tags", "must be an array of strings")).when(F.size(tags) > MAX_TAGS, say("tags", f"exceeds {MAX_TAGS} tags")).when(F.exists(tags, lambda t: t.isNull()), say("tags", "all tags must be strings")),
        F.when(targets.isNull(), say("install_target", "must be an array")),
    ]
    last = [F.when(number(n), say(f, "must be a non-negative finite number")) for f, n in (("stars", stars), ("forks", forks))]
    return F.array_compact(F.concat(F.array(*first), unknown, F.array(*last)))


def body_issues(agent: Column, size: Column) -> Column:
    """Issues of a batch itself: blank agent, empty or too large batch."""
    say = lambda field, message: F.struct(F.lit(field).alias("field"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))
    large = F.concat(F.lit("batch of "), size.cast("string"), F.lit(f" exceeds max {MAX_BATCH}; chunk upstream"))
    return F.array_compact(F.array(F.when(_blank(agent), say("agent", "required non-empty string")), F.when(size == 0, say("artifacts", "batch is empty")).when(size > MAX_BATCH, say("artifacts", large))))


def issue_table(batch: DataFrame, index: str, agent: str | None = None) -> DataFrame:
    """(index, field, message) of all issues; ``batch`` has the wire columns. Batch-level issues have index -1."""
    c = {n: F.col(n) for n in ("kind", "name", "source_url", "summary", "description", "tags", "install_target", "stars", "forks")}
    rows = batch.select(F.col(index).alias("index"), F.inline(issues(*c.values())))
    if agent is None:
        return rows
    head = batch.agg(F.count(F.lit(1)).alias("n")).select(F.lit(-1).alias("index"), F.inline(body_issues(F.lit(agent), F.col("n"))))
    return head.unionByName(rows)
