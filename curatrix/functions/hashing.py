"""Content identity: which parts of a record make it another version of itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions.text import normalize_text
from curatrix.functions.url import normalize_url


def identity_tags(tags: Column) -> Column:
    """Normalised tags in order, without empty ones."""
    clean = F.transform(F.coalesce(tags, F.array().cast("array<string>")), normalize_text)
    return F.array_sort(F.filter(clean, lambda t: t != ""))


def content_hash(kind: Column, name: Column, summary: Column, url: Column, license: Column, tags: Column) -> Column:
    """SHA-256 of the NUL-joined identity; stars, dates and other churn do not count."""
    fields = [F.coalesce(kind, F.lit("")), normalize_text(name), normalize_text(summary), normalize_url(url), normalize_text(license), F.array_join(identity_tags(tags), ",")]
    return F.sha2(F.concat_ws("\u0000", *fields), 256)
