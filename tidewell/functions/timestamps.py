"""Time columns: conversion, checks, and rounding to intervals in the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_TYPES = (T.DateType, T.LongType, T.TimestampType, T.TimestampNTZType)
VALUE_TYPES = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType)
#: Milliseconds of the named intervals.
STEPS = {"1min": 60_000, "5min": 300_000, "15min": 900_000, "30min": 1_800_000, "1h": 3_600_000, "6h": 21_600_000, "12h": 43_200_000, "1d": 86_400_000}
INTERVALS = (*STEPS, "1d_round")


def validate_series(df: DataFrame, time: str, value: str | None = None, group: str | None = None) -> None:
    """Raises ValueError unless the columns exist with the types that series operators take."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    for name in filter(None, (time, value, group)):
        if name not in fields:
            raise ValueError(f"column {name!r} is missing")
    if not isinstance(fields[time], TIME_TYPES):
        raise ValueError(f"{time!r} is no date, long or timestamp")
    if value:
        kind = fields[value].elementType if isinstance(fields[value], T.ArrayType) else fields[value]
        if not isinstance(kind, VALUE_TYPES):
            raise ValueError(f"{value!r} is neither a number nor an array of numbers")


def as_timestamp(df: DataFrame, time: str) -> Column:
    """A date, a long of epoch milliseconds or a timestamp, as a timestamp."""
    kind = df.schema[time].dataType
    if isinstance(kind, T.LongType):
        return F.timestamp_millis(time)
    if isinstance(kind, TIME_TYPES):
        return F.col(time).cast("timestamp")
    raise ValueError(f"{time!r} is no date, long or timestamp")


def to_millis(time: Column) -> Column:
    return F.unix_millis(time.cast("timestamp"))


def minmax(value: Column, low: Column | float, high: Column | float) -> Column:
    """(value - low) / (high - low); NaN or an infinity, as double division has it, where the band is 0."""
    low, high = F.lit(low).cast("double"), F.lit(high).cast("double")
    band, above = high - low, value.cast("double") - low
    none = F.when(above == 0, F.lit(float("nan"))).when(above > 0, F.lit(float("inf"))).otherwise(F.lit(-float("inf")))
    return F.when(band != 0, above / F.when(band != 0, band)).when(above.isNotNull() & band.isNotNull(), none)


def normalize_millis(millis: Column, interval: str) -> Column:
    """Epoch milliseconds, moved to an interval of the session's time zone: minutes and hours are rounded (halves up),
    5, 15 and 30 minutes, 6 and 12 hours are floored; "1d" goes down to midnight or noon, "1d_round" rounds at noon."""
    time = F.timestamp_millis(millis)
    hour, day = F.date_trunc("hour", time), F.date_trunc("day", time)

    def down(unit: Column, part: Column, step: int, seconds: int) -> Column:
        return F.unix_millis(unit) - F.pmod(part, F.lit(step)) * seconds * 1000

    if interval == "1min":
        return F.unix_millis(F.date_trunc("minute", F.timestamp_millis(millis + 30_000)))
    if interval in ("5min", "15min", "30min"):
        return down(F.date_trunc("minute", time), F.minute(time), int(interval[:-3]), 60)
    if interval == "1h":
        return F.unix_millis(F.date_trunc("hour", F.timestamp_millis(millis + 1_800_000)))
    if interval in ("6h", "12h"):
        return down(hour, F.hour(time), int(interval[:-1]), 3600)
    if interval == "1d":  # by the clock on the wall, also where a day has 23 or 25 hours
        wall = F.date_trunc("day", time).cast("timestamp_ntz")
        return F.unix_millis(F.when(F.hour(time) >= 12, wall + F.expr("INTERVAL 12 HOURS")).otherwise(wall).cast("timestamp"))
    if interval == "1d_round":
        return F.unix_millis(F.when(F.hour(time) >= 12, day + F.expr("INTERVAL 1 DAY")).otherwise(day))
    raise ValueError(f"unknown interval {interval!r}; known: {', '.join(INTERVALS)}")
