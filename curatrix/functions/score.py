"""The deterministic 0-100 quality score, its five parts and its notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions.text import utf16_length

#: Licences that permit reuse.
PERMISSIVE = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "CC0-1.0", "MPL-2.0"]
#: Lower bounds of the score bands.
BANDS = [(80, "well maintained"), (60, "solid"), (40, "usable"), (20, "gaps")]
LOWEST_BAND = "barely described"


def _length(text: Column) -> Column:
    return utf16_length(F.trim(F.coalesce(text, F.lit(""))))


def metadata(frontmatter: Column, summary: Column, tags: Column, targets: Column) -> Column:
    n, t = _length(summary), F.coalesce(F.size(tags), F.lit(0))
    total = F.when(frontmatter, 12).otherwise(0) + F.when(n >= 40, 7).when(n > 0, 3).otherwise(0)
    total = total + F.when(t >= 3, 4).when(t > 0, 2).otherwise(0) + F.when(F.coalesce(F.size(targets), F.lit(0)) > 0, 2).otherwise(0)
    return F.least(total, F.lit(25))


def documentation(readme: Column, examples: Column, description: Column) -> Column:
    n = _length(description)
    total = F.when(readme, 10).otherwise(0) + F.when(examples, 8).otherwise(0) + F.when(n >= 800, 7).when(n >= 250, 4).when(n > 0, 2).otherwise(0)
    return F.least(total, F.lit(25))


def freshness(days: Column) -> Column:
    fading = F.round(20 - ((days - 30) / 335) * 15).cast("int")
    return F.when(days.isNull(), 4).when(days <= 30, 20).when(days <= 365, fading).when(days <= 730, 3).otherwise(0)


def _declared(license: Column) -> Column:
    return F.coalesce((F.trim(license) != "") & (license != "NOASSERTION"), F.lit(False))


def licensing(license: Column) -> Column:
    return F.when(license.isin(PERMISSIVE), 10).when(_declared(license), 6).otherwise(0)


def popularity(stars: Column) -> Column:
    return F.least(F.round(F.log10(F.greatest(F.coalesce(stars, F.lit(0)), F.lit(0)) + 1) * 5).cast("int"), F.lit(20))


def breakdown(frontmatter: Column, summary: Column, tags: Column, targets: Column, readme: Column, examples: Column, description: Column, days: Column, license: Column, stars: Column) -> Column:
    """All parts and the total as a struct."""
    parts = {
        "metadata": metadata(frontmatter, summary, tags, targets),
        "documentation": documentation(readme, examples, description),
        "freshness": freshness(days),
        "licensing": licensing(license),
        "popularity": popularity(stars),
    }
    total = F.least(F.greatest(sum(parts.values(), F.lit(0)), F.lit(0)), F.lit(100))
    return F.struct(total.alias("score"), *(v.cast("int").alias(k) for k, v in parts.items()), F.lit(0).alias("discoverability"))


def notes(frontmatter: Column, summary: Column, readme: Column, examples: Column, days: Column, license: Column) -> Column:
    """Reasons for deductions, in a fixed order."""
    odd = F.concat(F.lit('License "'), license, F.lit('" may restrict reuse.'))
    said = [
        F.when(~frontmatter, "No valid frontmatter detected."),
        F.when(_length(summary) == 0, "Missing a description/summary."),
        F.when(~readme, "No README found."),
        F.when(~examples, "No usage examples detected."),
        F.when(days.isNull(), "Upstream last-modified date unknown.").when(days > 730, "Not updated in over two years.").when(days > 365, "Not updated in over a year."),
        F.when(_declared(license) & ~license.isin(PERMISSIVE), odd).when(~_declared(license), "No license declared — reuse rights are unclear."),
    ]
    return F.array_compact(F.array(*said))


def band(score: Column) -> Column:
    out = F.lit(LOWEST_BAND)
    for least, label in reversed(BANDS):
        out = F.when(score >= least, label).otherwise(out)
    return out
