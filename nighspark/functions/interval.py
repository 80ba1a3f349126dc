"""Closed time intervals given as two timestamp columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def widened(start: Column, end: Column, delta_ms: int) -> tuple[Column, Column]:
    """(start - delta, end + delta)."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(delta_ms / 1000).cast("decimal(18,6)"))
    return start - step, end + step


def intersects(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (start <= other_end) & (other_start <= end)


def contains(start: Column, end: Column, at: Column) -> Column:
    return (start <= at) & (at <= end)


def within(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether the first interval lies strictly inside the other."""
    return (start > other_start) & (end < other_end)


def reference_point(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """The later start, null if the intervals are disjoint."""
    return F.when(intersects(start, end, other_start, other_end), F.greatest(start, other_start))


def micros(t: Column, zoned: bool) -> Column:
    """Microseconds since 1970. A timestamp without zone is read off its fields, so no zone's clock changes shift it."""
    if zoned:
        return F.unix_micros(t)
    minutes = F.date_diff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 1440 + F.hour(t) * 60 + F.minute(t)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long")
