"""Link observations: verdicts and reasons for retiring a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: HTTP codes and thresholds of the link checks.
TERMINAL = [404, 410]
TRANSIENT = [429, 403, 500, 502, 503, 504]
UNREACHABLE_RUN = 3
STALE_DAYS = 180


def verdict(status: Column) -> Column:
    """ok, terminal or transient; no answer is transient."""
    return F.when((status >= 200) & (status < 400), "ok").when(status.isin(TERMINAL), "terminal").otherwise("transient")


def inactive_reason(terminal: Column, run: Column, days_old: Column) -> Column:
    """gone before unreachable before stale, else null."""
    return F.when(terminal, "gone").when(run >= UNREACHABLE_RUN, "unreachable").when(days_old > STALE_DAYS, "stale")
