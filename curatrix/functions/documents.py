"""Unstructured documents: frontmatter, markdown lists, robots rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINK = "^\\-\\s+\\[([^\\]]+)\\]\\(([^)]+)\\)"


def frontmatter(content: Column) -> Column:
    """key: value lines between the opening and the closing fence as a map; the last of equal keys wins."""
    body = F.regexp_extract(F.coalesce(content, F.lit("")), "(?s)^---\\r?\\n(.*?)\\r?\\n---", 1)
    lines = F.filter(F.split(body, "\\r?\\n"), lambda x: x.rlike("^\\s*[^:\\s][^:]*:"))
    key = lambda x: F.trim(F.substring_index(x, ":", 1))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, "^[^:]*:", "")), "^(['\"])(.*)\\1$", "$2")
    pairs = F.transform(lines, lambda x: F.struct(key(x).alias("k"), value(x).alias("v")))
    # A later line takes an earlier one's place.
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: ~F.exists(F.slice(pairs, p["i"] + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def frontmatter_valid(fields: Column) -> Column:
    filled = lambda k: F.coalesce(F.try_element_at(fields, F.lit(k)) != "", F.lit(False))
    return filled("name") & filled("description")


def list_links(content: Column) -> Column:
    """Links of a markdown list, in order: (line, name, url); badges and addresses without a path are left out."""
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), "\\r?\\n"), lambda x, i: F.struct(i.alias("line"), F.regexp_extract(x, LINK, 1).alias("name"), F.regexp_extract(x, LINK, 2).alias("url")))
    badge = lambda u: u.rlike("^https?://(img\\.)?shields\\.io|badge\\.") | (u.startswith("http") & u.rlike("badge|img"))
    return F.filter(lines, lambda x: (x["url"] != "") & ~badge(x["url"]) & x["url"].contains("/"))


def robots_rules(content: Column) -> Column:
    """(agent, allow, disallow, crawl_delay) of the last user-agent group; each User-agent line starts the lists anew.

    Rules before any named agent do not count, nor do lines that are comments. The last delay that is a number stays.
    """
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("agent"), empty.alias("allow"), empty.alias("disallow"), F.lit(None).cast("double").alias("crawl_delay"))

    def step(acc: Column, x: Column) -> Column:
        said = lambda name: F.lower(x).startswith(f"{name}:")
        value = F.regexp_replace(x, "^[^:]*:\\s*", "")
        grow = lambda side: F.when(acc["agent"] & said(side) & (value != ""), F.concat(acc[side], F.array(value))).otherwise(acc[side])
        number = F.when(value == "", F.lit(0.0)).otherwise(value.try_cast("double"))
        delay = F.when(acc["agent"] & said("crawl-delay"), F.coalesce(F.nanvl(number, F.lit(None).cast("double")), acc["crawl_delay"])).otherwise(acc["crawl_delay"])
        named = said("user-agent")
        return F.struct(
            F.when(named, value != "").otherwise(acc["agent"]).alias("agent"),
            F.when(named, empty).otherwise(grow("allow")).alias("allow"),
            F.when(named, empty).otherwise(grow("disallow")).alias("disallow"),
            delay.alias("crawl_delay"),
        )

    return F.aggregate(lines, start, step)


def robots_allowed(rules: Column, path: Column) -> Column:
    """Allowed where a rule allows the path or everything, else denied where one denies it, else allowed."""
    has = lambda side: F.exists(rules[side], lambda p: (p == path) | (p == "/"))
    return F.coalesce(F.when(has("allow"), True).when(has("disallow"), False).otherwise(True), F.lit(True))
