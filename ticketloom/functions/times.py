"""Dates and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timestamp(value: Column, pattern: str | None = None) -> Column:
    """Lenient parse: text that is no date gives NULL.

    Without ``pattern`` ISO-like text is read; day/month order is the caller's
    choice through ``pattern``.
    """
    if pattern is None:
        return value.try_cast("timestamp_ntz")
    return F.try_to_timestamp(value, F.lit(pattern)).cast("timestamp_ntz")


def hours_between(opened: Column, solved: Column) -> Column:
    """Hours with one decimal, half to even; NULL if a side is missing."""
    micros = F.timestamp_diff("MICROSECOND", opened, solved)
    return F.bround(micros / F.lit(3.6e9), 1)


def month_of(moment: Column) -> Column:
    return F.date_trunc("month", moment).cast("timestamp_ntz")
