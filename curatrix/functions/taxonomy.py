"""Categories of a record and its example signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds, tags and targets of the catalog with the categories they stand for.
KINDS = ["skill", "mcp", "ruleset", "subagent", "command"]
TAG_CATEGORY = {
    "ci": "skill",
    "testing": "skill",
    "quality": "skill",
    "deployment": "skill",
    "mcp": "mcp",
    "server": "mcp",
    "integration": "skill",
    "framework": "skill",
    "cli": "skill",
    "api": "skill",
}
TARGETS = ["claude-code", "claude-desktop", "cursor", "opencode", "windsurf", "zed", "continue", "generic"]
TARGET_CATEGORY = {
    "claude-code": "skill",
    "cursor": "skill",
    "opencode": "skill",
    "windsurf": "skill",
    "zed": "skill",
    "continue": "skill",
    "generic": "skill",
}
EXAMPLE_TAGS = ["ci", "testing", "cli", "api", "framework", "library", "component", "bin", "tool"]
EXAMPLE_TARGETS = ["claude-code", "cursor", "opencode", "windsurf"]
UNCATEGORIZED = "uncategorized"


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def map_categories(kind: Column, tags: Column, targets: Column) -> Column:
    """Distinct categories in order of kind, tags, targets; uncategorized if none."""
    none = F.array().cast("array<string>")
    own = F.when(kind.isin(KINDS), F.array(kind)).otherwise(none)
    by_tag = F.transform(F.coalesce(tags, none), lambda t: F.try_element_at(_lookup(TAG_CATEGORY), F.lower(t)))
    by_target = F.transform(F.coalesce(targets, none), lambda t: F.try_element_at(_lookup(TARGET_CATEGORY), t))
    found = F.array_distinct(F.array_compact(F.concat(own, by_tag, by_target)))
    return F.when(F.size(found) == 0, F.array(F.lit(UNCATEGORIZED))).otherwise(found)


def example_signals(tags: Column, targets: Column) -> Column:
    """Distinct tags and targets that suggest usage examples, in order."""
    none = F.array().cast("array<string>")
    by_tag = F.filter(F.transform(F.coalesce(tags, none), F.lower), lambda t: t.isin(EXAMPLE_TAGS))
    by_target = F.filter(F.coalesce(targets, none), lambda t: t.isin(EXAMPLE_TARGETS))
    return F.array_distinct(F.concat(by_tag, by_target))
