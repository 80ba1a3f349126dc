"""Interval columns as microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nighspark.functions.interval import micros


def micros_of(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.date_diff(F.col(name), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(F.col(name), isinstance(kind, T.TimestampType))
    raise TypeError(f"{name} is no timestamp: {kind.simpleString()}")


def window_of(df: DataFrame, time: tuple[str, str] | str, delta_ms: int) -> tuple[Column, Column]:
    start, end = (time, time) if isinstance(time, str) else time
    return micros_of(df, start) - delta_ms * 1000, micros_of(df, end) + delta_ms * 1000


def time_side(df: DataFrame, time, delta_ms: int) -> DataFrame:
    """df with __ns_lo and __ns_hi, without rows whose interval has a null."""
    lo, hi = window_of(df, time, delta_ms)
    return df.withColumn("__ns_lo", lo).withColumn("__ns_hi", hi).where("__ns_lo is not null and __ns_hi is not null")
