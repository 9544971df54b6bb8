"""Timestamps without zone, in microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(c: Column) -> Column:
    """Texts of ten characters as dates, others as date and time with a T; NULL where that fails."""
    day = F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))
    full = F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return F.when(F.char_length(c) == 10, day).otherwise(full).cast("timestamp_ntz")


def from_nanos(c: Column) -> Column:
    return F.timestamp_micros(F.call_function("div", c, F.lit(1000))).cast("timestamp_ntz")


year, month, day, hour = F.year, F.month, F.day, F.hour


def add_months(c: Column, n: int) -> Column:
    return (c + F.make_ym_interval(F.lit(0), F.lit(n))).cast("timestamp_ntz")


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds from a to b."""
    return F.timestamp_diff("SECOND", a, b)
