"""Date expressions with an injected clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def at(now: str | Column) -> Column:
    return F.lit(now).cast("timestamp") if isinstance(now, str) else now


def days_since(ts: Column, now: str | Column) -> Column:
    """Whole elapsed days; null for a missing date, 0 for a future one."""
    gap = F.unix_micros(at(now)) - F.unix_micros(ts.cast("timestamp"))
    return F.when(ts.isNotNull(), F.greatest(F.floor(gap / DAY_MICROS), F.lit(0)))


def iso(ts: Column) -> Column:
    """ISO 8601 in UTC, whole seconds."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_stale(last_seen: Column, days: int, now: str | Column) -> Column:
    """Never seen, or longer ago than ``days`` days to the microsecond."""
    gap = F.unix_micros(at(now)) - F.unix_micros(last_seen.cast("timestamp"))
    return last_seen.isNull() | (gap > days * DAY_MICROS)


def is_expired(expires: Column, now: str | Column) -> Column:
    """Past or exactly now; what is no timestamp has expired."""
    return F.coalesce(F.try_to_timestamp(expires) <= at(now), F.lit(True))
