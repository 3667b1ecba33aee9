"""Daily series of households: usable days, runs of days, zero days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_records(readings: DataFrame) -> DataFrame:
    """Per household and source date: on-grid intervals with a value, rows without one, off-grid rows, conflict, exact kWh.

    One aggregation to labels and one to days; a count of labels replaces a distinct count. The
    total counts each distinct value of an on-grid label once.
    """
    dated = readings.where(F.col("observed_at_naive").isNotNull() & F.col("household_id").isNotNull())
    values = dated.groupBy(
        "household_id", "observed_at_naive", F.coalesce("on_half_hour_grid", F.lit(False)).alias("grid"), "consumption_kwh", F.when(F.col("consumption_kwh").isNull(), F.col("value_category")).alias("category")
    ).agg(F.count("*").alias("n"))
    # Values and categories are distinct by now, so a label's signatures are its rows that have either.
    conflict = F.count_if(F.col("consumption_kwh").isNotNull() | F.col("category").isNotNull()) > 1
    labels = values.groupBy("household_id", "observed_at_naive", "grid").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("consumption_kwh").isNull(), F.col("n")).otherwise(0)).alias("blank"), conflict.alias("conflict"), F.sum("consumption_kwh").alias("kwh")
    )
    return labels.groupBy("household_id", F.to_date("observed_at_naive").alias("source_date")).agg(
        F.sum(F.when(F.col("grid"), F.col("kwh"))).cast("decimal(38,10)").alias("kwh"),
        F.count_if(F.col("grid") & F.col("kwh").isNotNull()).alias("grid_intervals"),
        F.sum("blank").alias("non_numeric_rows"),
        F.sum(F.when(~F.col("grid"), F.col("n")).otherwise(0)).alias("off_grid_rows"),
        F.max("conflict").alias("has_conflict"),
    )


def with_usability(days: DataFrame, expected_intervals: int = 48) -> DataFrame:
    """Add ``unusable_reason``, null for a usable day: too few intervals, then blanks, then a conflict."""
    reason = F.when(F.col("grid_intervals") < expected_intervals, "incomplete").when(F.col("non_numeric_rows") > 0, "non_numeric").when(F.col("has_conflict"), "conflict")
    return days.withColumn("unusable_reason", reason)


def runs(days: DataFrame) -> DataFrame:
    """(household_id, start, end, days): maximal runs of consecutive dates; repeated dates count once."""
    d = days.select("household_id", "source_date").distinct()
    island = F.date_sub("source_date", F.row_number().over(Window.partitionBy("household_id").orderBy("source_date")))
    return d.withColumn("island", island).groupBy("household_id", "island").agg(F.min("source_date").alias("start"), F.max("source_date").alias("end"), F.count("*").alias("days")).drop("island")


def longest_runs(days: DataFrame) -> DataFrame:
    """The longest run of each household; the earliest of equals."""
    best = F.max_by(F.struct("start", "end", "days"), F.struct("days", (-F.unix_date("start")).alias("early")))
    return runs(days).groupBy("household_id").agg(best.alias("b")).select("household_id", "b.*")


def feasibility(days: DataFrame) -> DataFrame:
    """One row: household-days, usable ones, and shortest, upper-median and longest of the longest runs.

    Households come down to a histogram of run lengths, which is no longer than the calendar.
    """
    usable = F.col("unusable_reason").isNull()
    place = F.row_number().over(Window.partitionBy("household_id", "u").orderBy("source_date"))
    d = days.select("household_id", "source_date", usable.alias("u")).withColumn("island", F.date_sub("source_date", place))
    per = d.groupBy("household_id", "u", "island").agg(F.count("*").alias("n")).groupBy("household_id").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("u"), F.col("n"))).alias("usable"), F.max(F.when(F.col("u"), F.col("n"))).alias("run"))
    hist = per.groupBy("run").agg(F.count("*").alias("h"), F.sum("all").alias("all"), F.sum("usable").alias("usable"))
    stairs = F.array_sort(F.collect_list(F.when(F.col("run").isNotNull(), F.struct("run", "h"))))
    one = hist.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("household_days"), F.coalesce(F.sum("usable"), F.lit(0)).alias("usable_days"), F.min("run").alias("shortest_run"), F.max("run").alias("longest_run"), stairs.alias("stairs"), F.sum(F.when(F.col("run").isNotNull(), F.col("h"))).alias("houses"))
    upto = lambda x: F.aggregate(F.filter("stairs", lambda y: y["run"] <= x["run"]), F.lit(0).cast("bigint"), lambda a, y: a + y["h"])
    median = F.get(F.filter("stairs", lambda x: upto(x) > F.floor(F.col("houses") / 2)), F.lit(0))["run"]
    return one.select("household_days", "usable_days", "shortest_run", median.alias("median_run"), "longest_run")


def zero_runs(days: DataFrame) -> DataFrame:
    """Runs of usable days with a total of exactly zero, with what lies before and after each.

    The neighbours are ``nonzero_usable``, ``unusable:`` and the reason, ``absent`` or
    ``recorded_span_edge``; a run is bounded between two nonzero usable days. Neighbours come from
    windows over a household's days, which are read once.
    """
    zero = F.coalesce(F.col("unusable_reason").isNull() & (F.col("kwh") == 0), F.lit(False))
    line = Window.partitionBy("household_id").orderBy("source_date")
    d = days.select("household_id", "source_date", zero.alias("zero"), F.coalesce(F.concat(F.lit("unusable:"), "unusable_reason"), F.lit("nonzero_usable")).alias("state"))

    def neighbour(move, days_away: int):
        at, state = move("source_date").over(line), move("state").over(line)
        return F.when(at.isNull(), "recorded_span_edge").when(F.datediff(at, F.col("source_date")) == days_away, state).otherwise("absent")

    place = F.row_number().over(Window.partitionBy("household_id", "zero").orderBy("source_date"))
    d = d.withColumns({"before": neighbour(F.lag, -1), "after": neighbour(F.lead, 1), "island": F.date_sub("source_date", place)}).where("zero")
    out = d.groupBy("household_id", "island").agg(
        F.min("source_date").alias("start"), F.max("source_date").alias("end"), F.count("*").alias("days"), F.min_by("before", "source_date").alias("before"), F.max_by("after", "source_date").alias("after")
    )
    return out.select("household_id", "start", "end", "days", "before", "after", ((F.col("before") == "nonzero_usable") & (F.col("after") == "nonzero_usable")).alias("bounded"), run_bucket(F.col("days")).alias("bucket"))


# The least lengths of the buckets of runs.
BUCKETS = {"28+": 28, "7-27": 7, "2-6": 2, "1": 1}


def run_bucket(days: Column) -> Column:
    """The bucket of a run's length."""
    return F.coalesce(*[F.when(days >= least, name) for name, least in BUCKETS.items()])


def zero_days_by_household(zero: DataFrame) -> DataFrame:
    """Per household: zero days, runs, bounded runs, the longest run and runs by bucket."""
    return zero.groupBy("household_id").agg(
        F.sum("days").alias("zero_days"),
        F.count("*").alias("runs"),
        F.count_if("bounded").alias("bounded_runs"),
        F.max("days").alias("longest_run"),
        *[F.count_if(F.col("bucket") == b).alias(f"runs_{b.replace('-', '_').replace('+', '_up')}") for b in reversed(BUCKETS)],
    )


def zero_days_summary(zero: DataFrame) -> DataFrame:
    """One row over all households: the same counts, households, and the longest run, the larger id of equals."""
    per = zero_days_by_household(zero)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = [c for c in per.columns if c not in ("household_id", "longest_run")]
    return per.agg(F.count("*").alias("households"), *map(total, sums), F.max("longest_run").alias("longest_run"), F.max_by("household_id", F.struct("longest_run", "household_id")).alias("longest_household"))
