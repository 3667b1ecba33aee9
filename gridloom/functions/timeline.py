"""Exact arithmetic on naive timestamps, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_HOUR_US = 1_800_000_000
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(col: Column) -> Column:
    """Microseconds from 1970-01-01 00:00 on the same naive clock."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), col)


def from_micros(col: Column) -> Column:
    """The naive timestamp of a microsecond count."""
    return F.timestamp_add("MICROSECOND", col, F.expr(EPOCH))


def stamp(col: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` of a naive timestamp."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def floor_div(col: Column, step: int) -> Column:
    """Floor division of a bigint, also below zero."""
    return F.call_function("div", col - F.pmod(col, F.lit(step)), F.lit(step))
