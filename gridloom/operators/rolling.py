"""Rolling totals over trailing periods by event-contribution deltas (problem 2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.timeline import from_micros


def daily_amounts(usable: DataFrame) -> DataFrame:
    """(household_id, day, kwh, n): exact daily sums of usable readings, active days only."""
    return usable.groupBy("household_id", F.to_date(from_micros(F.col("at_us"))).alias("day")).agg(
        F.sum("kwh").alias("kwh"), F.count("*").alias("n")
    )


def trailing_segments(daily: DataFrame, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """(household_id, window_days, from_day, to_day, kwh, n): the trailing sums, as runs of days.

    Each active day contributes its amount at its date and the negated amount ``window`` days
    later; the running sum of those deltas is the trailing total, constant between two events.
    A household has at most two events a day and window, so a hot household stays as small as its
    calendar. Null amounts count as nothing; rows without household or day are left out.
    """
    active = daily.where(F.col("household_id").isNotNull() & F.col("day").isNotNull())
    spread = active.select("household_id", "day", "kwh", "n", F.explode(F.array(*map(F.lit, windows))).alias("window_days"))
    delta = spread.select(
        "household_id",
        "window_days",
        F.explode(
            F.array(
                F.struct(F.col("day").alias("at"), F.col("kwh").alias("d_kwh"), F.col("n").alias("d_n"), F.col("day").alias("active_day")),
                F.struct(F.date_add("day", F.col("window_days")).alias("at"), (-F.col("kwh")).alias("d_kwh"), (-F.col("n")).alias("d_n"), F.lit(None).cast("date").alias("active_day")),
            )
        ).alias("e"),
    ).select("household_id", "window_days", "e.*")
    events = delta.groupBy("household_id", "window_days", "at").agg(
        F.sum("d_kwh").alias("d_kwh"), F.sum("d_n").alias("d_n"), F.max("active_day").alias("active_day")
    )
    whole = Window.partitionBy("household_id", "window_days")
    running = whole.orderBy("at")
    return (
        events.select(
            "household_id",
            "window_days",
            F.col("at").alias("from_day"),
            F.coalesce(F.date_sub(F.lead("at").over(running), 1), F.col("at")).alias("until"),
            F.sum("d_kwh").over(running).alias("kwh"),
            F.sum("d_n").over(running).alias("n"),
            F.max("active_day").over(whole).alias("last_day"),
        )
        .where(F.col("from_day") <= F.col("last_day"))
        .select("household_id", "window_days", "from_day", F.least("until", "last_day").alias("to_day"), "kwh", "n")
    )


def rolling_totals(daily: DataFrame, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """One row per household, day from its first to its last active day, and window.

    total_kwh is the exact sum over the ``window_days`` days ending with the day (0 when none is
    active), average_kwh that total over window_days, also on the first days of a series;
    readings counts the rows behind it. An empty input gives no rows.
    """
    return trailing_segments(daily, windows).select(
        "household_id",
        F.explode(F.sequence("from_day", "to_day")).alias("day"),
        F.col("window_days").cast("bigint").alias("window_days"),
        F.coalesce("kwh", F.lit(0)).cast("decimal(38,10)").alias("total_kwh"),
        (F.coalesce("kwh", F.lit(0)).cast("double") / F.col("window_days")).alias("average_kwh"),
        F.col("n").alias("readings"),
    )


def silent_windows(daily: DataFrame, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Household-days whose trailing window holds no reading: (household_id, reading_day, window_days)."""
    return (
        trailing_segments(daily, windows)
        .where(F.col("n") == 0)
        .select("household_id", F.explode(F.sequence("from_day", "to_day")).alias("day"), "window_days")
        .select("household_id", F.date_format("day", "yyyy-MM-dd").alias("reading_day"), F.col("window_days").cast("bigint").alias("window_days"))
    )
