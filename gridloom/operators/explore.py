"""Steps, gaps, daily totals and undisputed series of households.

Windows run per household and month of the label, with the label before each month carried in by a
scan over month summaries, so one household's readings never have to meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.policy import conflicting_labels, signature

STEP_SECONDS = 1800


def on_grid(readings: DataFrame) -> DataFrame:
    return readings.where(F.col("on_half_hour_grid") & F.col("observed_at_naive").isNotNull())


def carried_lag(df: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    """Add the previous value of ``at`` within ``keys``, by month shards with carry."""
    cut = df.withColumn("_m", F.trunc(F.col(at), "month"))
    tails = cut.groupBy(*keys, "_m").agg(F.max(at).alias("_tail"))
    carry = tails.select(*keys, "_m", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_m")).alias("_carry"))
    inside = Window.partitionBy(*keys, "_m").orderBy(at)
    return cut.join(carry, [*keys, "_m"]).withColumn(name, F.coalesce(F.lag(at).over(inside), F.col("_carry"))).drop("_m", "_carry")


def step_gaps(readings: DataFrame, expected: int = STEP_SECONDS) -> DataFrame:
    """Steps longer than expected between distinct on-grid labels; a gap belongs to the later date."""
    labels = on_grid(readings).select("household_id", "observed_at_naive").distinct().where(F.col("household_id").isNotNull())
    return (
        carried_lag(labels, ["household_id"], "observed_at_naive", "from_at")
        .withColumn("step_seconds", F.timestamp_diff("SECOND", F.col("from_at"), F.col("observed_at_naive")))
        .where(F.col("step_seconds") > expected)
        .select("household_id", F.col("from_at").alias("from_timestamp"), F.col("observed_at_naive").alias("to_timestamp"), "step_seconds", F.to_date("observed_at_naive").alias("attributed_date"))
    )


def off_grid_rows(readings: DataFrame) -> DataFrame:
    """Distinct readings whose label has an instant off the grid."""
    return readings.where(F.col("observed_at_naive").isNotNull() & ~F.coalesce("on_half_hour_grid", F.lit(False))).select("household_id", "source_timestamp_text", "observed_at_naive", "consumption_kwh").distinct()


def daily_totals(readings: DataFrame) -> DataFrame:
    """Per household and source date, the dates between its first and last included.

    Raw and distinct counts, missing values, off-grid rows, conflicts, the exact on-grid total and
    whether it is published, withheld (a conflict that day) or none. Days without rows have
    ``has_rows`` false, zero counts and no total: absence is no zero.
    """
    dated = readings.where(F.col("observed_at_naive").isNotNull() & F.col("household_id").isNotNull()).withColumn("source_date", F.to_date("observed_at_naive"))
    labels = (
        dated.withColumn("sig", signature())
        .groupBy("household_id", "source_date", "source_timestamp_text", "on_half_hour_grid", "sig", "consumption_kwh")
        .agg(F.count("*").alias("n"))
        .groupBy("household_id", "source_date", "source_timestamp_text", "on_half_hour_grid")
        .agg(F.sum("n").alias("n"), F.count("*").alias("readings"), (F.min("sig") != F.max("sig")).alias("conflict"), F.sum("consumption_kwh").alias("kwh"), F.count_if(F.col("consumption_kwh").isNull()).alias("missing"))
    )
    grid = F.coalesce("on_half_hour_grid", F.lit(False))
    days = labels.groupBy("household_id", "source_date").agg(
        F.sum("n").alias("raw_rows"),
        F.sum("readings").alias("distinct_readings"),
        F.sum("missing").alias("missing_values"),
        F.sum(F.when(grid, 0).otherwise(F.col("n"))).alias("off_grid_rows"),
        F.sum(F.when(grid, F.col("kwh"))).alias("grid_kwh"),
        F.max(F.col("conflict")).alias("has_conflict"),
    )
    spans = days.groupBy("household_id").agg(F.min("source_date").alias("lo"), F.max("source_date").alias("hi"))
    calendar = spans.select("household_id", "lo", "hi", F.explode(F.sequence("lo", "hi")).alias("source_date"))
    full = calendar.join(days, ["household_id", "source_date"], "left")
    has_rows = F.col("raw_rows").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    status = F.when(~has_rows | F.col("grid_kwh").isNull() & ~F.col("has_conflict"), "none").when(F.col("has_conflict"), "withheld").otherwise("published")
    return full.select(
        "household_id",
        "source_date",
        zero("raw_rows"),
        zero("distinct_readings"),
        zero("missing_values"),
        zero("off_grid_rows"),
        (F.coalesce("raw_rows", F.lit(0)) - F.coalesce("distinct_readings", F.lit(0))).alias("duplicates_removed"),
        F.coalesce("has_conflict", F.lit(False)).alias("has_conflict"),
        has_rows.alias("has_rows"),
        ((F.col("source_date") == F.col("lo")) | (F.col("source_date") == F.col("hi"))).alias("is_boundary_day"),
        status.alias("total_status"),
        F.when(status == "published", F.col("grid_kwh")).cast("decimal(38,10)").alias("recorded_kwh"),
    )


def period_summary(readings: DataFrame) -> DataFrame:
    """Per household over its whole span: days with and without rows, issues, and the total unless withheld."""
    d = daily_totals(readings)
    withheld = F.max(F.col("has_conflict"))
    return d.groupBy("household_id").agg(
        F.count_if(F.col("has_rows")).alias("days_with_rows"),
        F.count_if(~F.col("has_rows")).alias("days_without_rows"),
        F.sum("missing_values").alias("missing_values"),
        F.sum("duplicates_removed").alias("duplicates_removed"),
        F.count_if(F.col("has_conflict")).alias("conflict_days"),
        F.when(withheld, "conflicting labels").alias("withheld_reason"),
        F.when(~withheld, F.sum("recorded_kwh")).cast("decimal(38,10)").alias("total_kwh"),
    )


def half_hour_detail(readings: DataFrame) -> DataFrame:
    """The undisputed on-grid series: one row a label, labels in conflict left out, breaks marked.

    ``breaks_before`` tells where a line must not be drawn from the row before.
    """
    undisputed = on_grid(readings).where(F.col("consumption_kwh").isNotNull() & F.col("household_id").isNotNull()).join(conflicting_labels(readings), ["household_id", "source_timestamp_text"], "left_anti")
    series = undisputed.select("household_id", "observed_at_naive", "consumption_kwh").distinct()
    return carried_lag(series, ["household_id"], "observed_at_naive", "prev").select(
        "household_id", "observed_at_naive", "consumption_kwh", F.coalesce(F.timestamp_diff("SECOND", F.col("prev"), F.col("observed_at_naive")) > STEP_SECONDS, F.lit(False)).alias("breaks_before")
    )


def preset_window(readings: DataFrame, days: int) -> DataFrame:
    """Per household: the last ``days`` days of its dates, cut at its first."""
    b = readings.where(F.col("observed_at_naive").isNotNull()).groupBy("household_id").agg(F.to_date(F.min("observed_at_naive")).alias("first_date"), F.to_date(F.max("observed_at_naive")).alias("last_date"))
    return b.withColumn("window_start", F.greatest("first_date", F.date_sub("last_date", days - 1)))


def step_order(readings: DataFrame, block: int = 100_000) -> DataFrame:
    """Per household: steps back and repeated labels in file order (record number).

    Cut into blocks of record numbers; the last instant of the block before is carried in.
    """
    rows = readings.where(F.col("observed_at_naive").isNotNull() & F.col("source_record_no").isNotNull()).select("household_id", "source_record_no", "observed_at_naive", F.call_function("div", F.col("source_record_no"), F.lit(block)).alias("b"))
    keys = ["household_id", "b"]
    tails = rows.groupBy(*keys).agg(F.max_by("observed_at_naive", "source_record_no").alias("tail"))
    carry = tails.select(*keys, F.lag("tail").over(Window.partitionBy("household_id").orderBy("b")).alias("carry"))
    same = (rows["household_id"].eqNullSafe(carry["household_id"])) & (rows["b"] == carry["b"])
    prev = F.coalesce(F.lag("observed_at_naive").over(Window.partitionBy(rows["household_id"], rows["b"]).orderBy("source_record_no")), F.col("carry"))
    stepped = rows.join(carry, same).select(rows["household_id"], "observed_at_naive", prev.alias("prev"))
    return stepped.groupBy("household_id").agg(
        F.count_if(F.col("observed_at_naive") < F.col("prev")).alias("steps_back"), F.count_if(F.col("observed_at_naive") == F.col("prev")).alias("repeats"), F.count("*").alias("row_count")
    )


def label_at(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
