"""Usable readings: the common input of the time-series operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import household_key
from gridloom.functions.timeline import micros


def usable_readings(readings: DataFrame) -> DataFrame:
    """(household_id, at_us, kwh): readings with an unresolved zone status, an instant and a value.

    household_id is given out in its canonical form and equal (household, instant, value)
    triples count once; rows without any of the parts, or without a household, are left out.
    The filter and the five columns reach the scan; repeats collapse map-side before the shuffle,
    so a hot household or a much repeated reading costs no more than its distinct rows.
    """
    return (
        readings.where(
            (F.col("timezone_status") == "unresolved")
            & F.col("observed_at_naive").isNotNull()
            & F.col("consumption_kwh").isNotNull()
            & F.col("household_id").isNotNull()
        )
        .select(
            household_key(F.col("household_id")).alias("household_id"),
            micros(F.col("observed_at_naive")).alias("at_us"),
            F.col("consumption_kwh").alias("kwh"),
        )
        .where(F.col("household_id").isNotNull())
        .distinct()
    )
