"""Profiling of raw records: classes of values and labels, exact distribution, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.text import strip
from gridloom.operators.analytics import small
from gridloom.operators.policy import RAW_KEY
from gridloom.operators.rejects import FINITE, LOADER_FORMAT
from gridloom.storage import materialize

NON_FINITE = r"(?i)^[+-]?(?:inf|infinity|s?nan[0-9]*)$"


def value_category(raw: Column) -> Column:
    """empty, null_token (exactly ``Null``), finite_numeric, non_finite_numeric or unexpected_token of a raw text.

    White space around the text is disregarded; underscores within digits are allowed as in a
    decimal literal. A null text gives null.
    """
    text = strip(raw)
    bare = F.replace(text, F.lit("_"), F.lit(""))
    return F.when(text == "", "empty").when(text == "Null", "null_token").when(bare.rlike(FINITE), "finite_numeric").when(bare.rlike(NON_FINITE), "non_finite_numeric").when(raw.isNotNull(), "unexpected_token")


def value_classes(readings: DataFrame) -> DataFrame:
    """Readings by category of their raw text, with padded texts counted."""
    raw = F.col("consumption_raw_text")
    return readings.groupBy(value_category(raw).alias("category")).agg(F.count("*").alias("row_count"), F.count_if(strip(raw) != raw).alias("padded"))


def label_classes(readings: DataFrame) -> DataFrame:
    """Readings by validity of their label in the loader's format and by lying on the half-hour grid."""
    t = F.col("source_timestamp_text")
    at = F.when(t.rlike(LOADER_FORMAT), F.substring(t, 1, 26)).try_cast("timestamp_ntz")
    on = (F.minute(at).isin(0, 30)) & (F.second(at) == 0) & (F.substring(t, 21, 6) == "000000")
    kind = F.when(at.isNull(), "invalid").when(on, "on_grid").otherwise("off_grid")
    return readings.groupBy(kind.alias("label_class")).agg(F.count("*").alias("row_count"))


def partitions(readings: DataFrame) -> DataFrame:
    """One row of counters that must add up: by category, by grid, by validity."""
    return readings.agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("value_category") == "finite_numeric").alias("finite_values"),
        F.count_if(F.col("value_category") != "finite_numeric").alias("other_values"),
        F.count_if(F.col("on_half_hour_grid")).alias("on_grid"),
        F.count_if(~F.col("on_half_hour_grid")).alias("off_grid"),
        F.count_if(F.col("on_half_hour_grid").isNull()).alias("without_instant"),
        F.count_if(F.col("consumption_kwh") < 0).alias("negative"),
        F.count_if(F.col("consumption_kwh") == 0).alias("zero"),
    )


def duplicate_stats(readings: DataFrame) -> DataFrame:
    """One row: raw-text groups with repeats, extra rows and rows involved."""
    g = readings.groupBy(*RAW_KEY).agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_involved"))


def collision_stats(readings: DataFrame) -> DataFrame:
    """One row: labels with several rows, and those whose group, value or raw text disagree.

    Here two numbers agree by value, other texts by their text, and a differing tariff group counts
    as a disagreement.
    """
    key = F.coalesce(F.concat(F.lit("num:"), F.col("consumption_kwh").cast("string")), F.concat(F.lit("raw:"), F.col("consumption_raw_text")))
    g = readings.groupBy("household_id", "source_timestamp_text").agg(F.count("*").alias("n"), F.coalesce(F.min(key) != F.max(key), F.lit(False)).alias("v"), F.coalesce(F.min("tariff_group") != F.max("tariff_group"), F.lit(False)).alias("t")).where("n > 1")
    return g.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_involved"), F.count_if(F.col("v") | F.col("t")).alias("disagreeing_keys"))


def nearest_rank_percentiles(readings: DataFrame, percents: tuple[int, ...] = (1, 5, 25, 50, 75, 95, 99)) -> DataFrame:
    """(percent, rank, value): the observed value at rank ceil(p n / 100), exact.

    Ranks come from running counts over distinct values in two levels: ranges of a range
    partitioning, one summary row each, then the values inside a range, so the column is never
    sorted in one task.
    """
    values = readings.where(F.col("consumption_kwh").isNotNull()).groupBy("consumption_kwh").agg(F.count("*").alias("n"))
    placed = materialize(values.repartitionByRange("consumption_kwh").withColumn("part", F.spark_partition_id()), "values")
    parts = placed.groupBy("part").agg(F.sum("n").alias("c"))
    before = parts.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy(F.lit(1))).alias("total"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("consumption_kwh").rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.join(small(before), "part").select("consumption_kwh", upto.alias("upto"), "n", "total")
    wanted = F.array(*[F.struct(F.lit(p).cast("bigint").alias("percent"), F.ceil(F.lit(p) * F.col("total") / 100).alias("rank")) for p in percents])
    hit = lambda w: (w["rank"] <= F.col("upto")) & (w["rank"] > F.col("upto") - F.col("n"))
    return ranked.select(F.inline(F.filter(wanted, hit)), F.col("consumption_kwh").alias("value"))


def interquartile_range(readings: DataFrame) -> DataFrame:
    """One row: nearest-rank quartiles and their difference, exact; no row without values."""
    p = nearest_rank_percentiles(readings, (25, 75)).agg(F.max(F.when(F.col("percent") == 25, F.col("value"))).alias("q25"), F.max(F.when(F.col("percent") == 75, F.col("value"))).alias("q75"))
    return p.where("q25 is not null").select("q25", "q75", (F.col("q75") - F.col("q25")).cast("decimal(38,10)").alias("iqr"))


def distribution(readings: DataFrame) -> DataFrame:
    """One row: count, least, greatest, range, exact sum and mean of the finite values.

    The mean has 9 places, rounded half even from the exact sum: the quotient is taken in integers.
    """
    v = F.col("consumption_kwh")
    one = readings.agg(F.count(v).alias("finite_values"), F.min(v).alias("least"), F.max(v).alias("greatest"), (F.max(v) - F.min(v)).cast("decimal(38,10)").alias("value_range"), F.sum(v).alias("total"))
    # The sum in units of 10^-10, divided by ten counts: the integer part is the mean in units of 10^-9.
    units, by = (F.abs("total") * F.lit(10**10).cast("decimal(11,0)")).cast("decimal(38,0)"), (F.nullif("finite_values", F.lit(0)) * 10).cast("decimal(20,0)")
    whole = F.floor(units / by).cast("decimal(38,0)")
    twice = (units - whole * by) * 2
    up = F.when((twice > by) | ((twice == by) & (whole % 2 == 1)), 1).otherwise(0)
    mean = (F.when(F.col("total") < 0, -1).otherwise(1) * (whole + up)).cast("decimal(28,0)") * F.lit("0.000000001").cast("decimal(9,9)")
    return one.select("*", mean.cast("decimal(28,9)").alias("mean"))


def extreme_values(readings: DataFrame, limit: int = 5, largest: bool = True) -> DataFrame:
    """The most extreme values, ties by record number; the limit is the feature."""
    rows = readings.where(F.col("consumption_kwh").isNotNull()).select("source_record_no", "household_id", "consumption_kwh")
    return rows.orderBy(F.desc("consumption_kwh") if largest else F.asc("consumption_kwh"), "source_record_no").limit(limit)


def group_values(readings: DataFrame) -> DataFrame:
    return readings.groupBy("tariff_group").agg(F.count("*").alias("row_count"), F.countDistinct("household_id").alias("households"))


def member_profile(readings: DataFrame) -> DataFrame:
    """Per member: rows, households, instants' span, finite values and exact total."""
    return readings.groupBy("archive_name", "member_name").agg(F.count("*").alias("row_count"), F.countDistinct("household_id").alias("households"), F.min("observed_at_naive").alias("first_at"), F.max("observed_at_naive").alias("last_at"), F.count("consumption_kwh").alias("finite_values"), F.sum("consumption_kwh").alias("total_kwh"))
