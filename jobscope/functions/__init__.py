"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_seconds(clock: Column) -> Column:
    """Seconds of ``S``, ``MM:SS``, ``H:MM:SS`` or ``D:H:MM:SS``; null for anything else, such as ``?``."""
    parts = F.transform(F.split(clock, ":"), lambda p: p.try_cast("bigint"))
    units = F.array(*[F.lit(u).cast("bigint") for u in (1, 60, 3600, 86400)])
    total = F.aggregate(F.zip_with(F.reverse(parts), units, lambda p, u: F.coalesce(p, F.lit(0)) * u), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when((F.size(parts) <= 4) & ~F.exists(parts, lambda p: p.isNull()), total)


def duration_text(seconds: Column) -> Column:
    """``42s``, ``1.5m`` or ``2.0h`` of whole seconds, tenths rounded half up; ``-`` if null or negative."""
    tenths = lambda unit: F.floor((F.floor(seconds) * 10 + unit // 2) / unit) / F.lit(10.0)
    return (
        F.when(seconds.isNull() | (seconds < 0), "-")
        .when(seconds < 60, F.concat(F.floor(seconds).cast("string"), F.lit("s")))
        .when(seconds < 3600, F.format_string("%.1fm", tenths(60)))
        .otherwise(F.format_string("%.1fh", tenths(3600)))
    )


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def prefix_of(text: Column) -> Column:
    """All before the last ``/``, or the whole text if it has none."""
    return F.regexp_replace(text, "/[^/]*$", "")


PRIORITIES = {"high": 0, "normal": 1, "low": 2}


def priority_rank(priority: Column) -> Column:
    rank = F.lit(1)
    for name, r in PRIORITIES.items():
        rank = F.when(priority == name, r).otherwise(rank)
    return rank


ACTIVE = ("running", "launching", "queued")
TERMINAL = ("done", "failed", "cancelled", "evicted")
