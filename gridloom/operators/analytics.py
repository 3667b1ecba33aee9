"""Aggregates over the charge fact and the band schedule, and joins by label and validity range.

All sums stay decimal; shares are ratios of decimals turned into doubles once, at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.display import ENERGY, MONEY, PRICE, band_order, displayed, ratio, share_percent
from gridloom.operators.policy import conflicting_labels, distinct_readings

from gridloom.storage import materialize

BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16_000_000


def share(part: Column, whole: Column, scale: int = 10) -> Column:
    """part / whole as a double, rounded once, half up, to 6 places from the exact values; null for a whole of 0."""
    return ratio(part, whole, 6, scale).cast("double")


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the table is checked to hold at most ``most`` rows and ``most_bytes`` of text and
    numbers, else leave the join to Spark. The check is a job that reads at most ``most`` rows."""
    size = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) if f.dataType.simpleString() in ("string", "binary") else F.lit(16) for f in df.schema]
    held = df.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(reduce(lambda a, b: a + b, size)), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if held.n <= most and held.b <= most_bytes else df


def banded_readings(readings: DataFrame, schedule: DataFrame, prices: DataFrame) -> DataFrame:
    """Distinct readings with the band of their label and the price valid on their day, if any.

    Labels match by equality, prices by group and band within the half-open validity
    [from, until); a price with an unknown bound matches nothing. Conflicts and labels outside the
    schedule's span, off-grid labels, missing values, labels without a band and bands without a price
    are flagged, not removed.
    """
    d = distinct_readings(readings)
    bands = small(schedule.select(F.col("schedule_label_naive").alias("observed_at_naive"), "band_label"))
    lo, hi = (schedule.agg(f("schedule_label_naive")).scalar() for f in (F.min, F.max))
    disputed = conflicting_labels(readings).withColumn("is_conflict", F.lit(True))
    x = d.join(bands, "observed_at_naive", "left").join(disputed, ["household_id", "source_timestamp_text"], "left").withColumns({"lo": lo, "hi": hi})
    p = small(prices.select(F.col("tariff_group").alias("g"), F.col("band_label").alias("b"), "price_pence_per_kwh", "price_gbp_per_kwh", "effective_from", "effective_until"))
    day = F.to_date("observed_at_naive")
    valid = (F.col("tariff_group") == F.col("g")) & (F.col("band_label") == F.col("b")) & (day >= F.col("effective_from")) & (day < F.col("effective_until"))
    return x.join(p, valid, "left").select(
        *d.columns,
        "band_label",
        "price_gbp_per_kwh",
        F.coalesce("is_conflict", F.lit(False)).alias("is_conflict"),
        (~F.coalesce(F.col("observed_at_naive").between(F.col("lo"), F.col("hi")), F.lit(False))).alias("outside_schedule"),
        (~F.coalesce("on_half_hour_grid", F.lit(False))).alias("is_off_grid"),
        (F.coalesce(F.col("value_category") != "finite_numeric", F.lit(True)) | F.col("consumption_kwh").isNull()).alias("is_missing_value"),
        F.col("band_label").isNull().alias("is_unmatched_label"),
        (F.col("band_label").isNotNull() & F.col("price_gbp_per_kwh").isNull()).alias("is_unpriced_band"),
        (F.col("consumption_kwh") * F.col("price_gbp_per_kwh")).cast("decimal(38,16)").alias("amount_gbp"),
    )


def band_summary(fact: DataFrame) -> DataFrame:
    """Per band: rows, households, exact kWh and amount, and both shares of the same rows."""
    g = fact.groupBy("band_label").agg(F.count("*").alias("row_count"), F.countDistinct("household_id").alias("households"), F.sum("consumption_kwh").alias("kwh"), F.sum("energy_charge_gbp").alias("amount_gbp"))
    all_ = Window.partitionBy(F.lit(1))  # over the few bands, after the aggregation
    return g.withColumns({"kwh_share": share(F.col("kwh"), F.sum("kwh").over(all_)), "amount_share": share(F.col("amount_gbp"), F.sum("amount_gbp").over(all_), 16)})


def band_by_hour(fact: DataFrame) -> DataFrame:
    return fact.groupBy("band_label", F.col("source_hour").cast("bigint").alias("source_hour")).agg(F.count("*").alias("row_count"), F.sum("consumption_kwh").alias("kwh"))


def by_month(fact: DataFrame) -> DataFrame:
    return fact.groupBy(F.col("source_month").cast("bigint").alias("source_month"), "band_label").agg(F.count("*").alias("row_count"), F.sum("consumption_kwh").alias("kwh"), F.sum("energy_charge_gbp").alias("amount_gbp"))


def household_totals(fact: DataFrame) -> DataFrame:
    """Per household: rows, date span, exact kWh and amount."""
    return fact.groupBy("household_id").agg(F.count("*").alias("row_count"), F.min("source_date").alias("first_date"), F.max("source_date").alias("last_date"), F.sum("consumption_kwh").alias("kwh"), F.sum("energy_charge_gbp").alias("amount_gbp"))


def high_rank(fact: DataFrame, band: str = "High") -> DataFrame:
    """Households ranked by their share of kWh in a band, ids breaking ties.

    Sorted as a whole by range partitioning on (share, id), so equal shares spread too; each
    partition is then ranked by itself and shifted by the sizes of those before it, one row each.
    """
    g = fact.groupBy("household_id").agg(share(F.coalesce(F.sum(F.when(F.col("band_label") == band, F.col("consumption_kwh"))), F.lit(0)), F.sum("consumption_kwh")).alias("band_share")).where(F.col("band_share").isNotNull())
    placed = materialize(g.repartitionByRange(F.desc("band_share"), F.asc_nulls_first("household_id")).withColumn("part", F.spark_partition_id()), "ranked")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("band_share"), "household_id"))
    return placed.join(small(before), "part").select("household_id", "band_share", (inside + F.col("before")).alias("rank"))


def schedule_distribution(schedule: DataFrame) -> DataFrame:
    at = F.col("schedule_label_naive")
    return schedule.groupBy("band_label", F.month(at).cast("bigint").alias("month"), F.hour(at).cast("bigint").alias("hour")).agg(F.count("*").alias("slots"))


def schedule_totals(schedule: DataFrame) -> DataFrame:
    g = schedule.groupBy("band_label").agg(F.count("*").alias("slots"))
    return g.select("band_label", "slots", (F.col("slots").cast("double") / 2).alias("hours"), share(F.col("slots"), F.sum("slots").over(Window.partitionBy(F.lit(1)))).alias("slot_share"))


def schedule_steps(schedule: DataFrame) -> DataFrame:
    """Histogram of the steps between neighbouring labels, by month with the next month's head carried back."""
    m = schedule.select(F.col("schedule_label_naive").alias("at")).withColumn("m", F.trunc("at", "month"))
    heads = m.groupBy("m").agg(F.min("at").alias("head"))
    heads = heads.select("m", F.lead("head").over(Window.orderBy("m")).alias("head"))
    nxt = F.coalesce(F.lead("at").over(Window.partitionBy("m").orderBy("at")), F.col("head"))
    steps = m.join(small(heads), "m").withColumn("next", nxt).where(F.col("next").isNotNull())
    return steps.groupBy(F.timestamp_diff("SECOND", F.col("at"), F.col("next")).alias("step_seconds")).agg(F.count("*").alias("steps"))


def insights(fact: DataFrame) -> DataFrame:
    """One row: the band whose amount share most exceeds its kWh share, the hour with most kWh, and
    the households with fewest and most rows; ties by name."""
    bands = band_summary(fact).agg(F.max_by("band_label", F.struct(F.col("amount_share") - F.col("kwh_share"), "band_label")).alias("dearest_band"))
    hours = fact.groupBy(F.col("source_hour").cast("bigint").alias("h")).agg(F.sum("consumption_kwh").alias("kwh")).agg(F.max_by("h", F.struct("kwh", "h")))
    houses = fact.groupBy("household_id").agg(F.count("*").alias("n"))
    least, most = (houses.agg(f("household_id", F.struct("n", "household_id"))).scalar() for f in (F.min_by, F.max_by))
    return bands.select("dearest_band", hours.scalar().alias("peak_hour"), least.alias("fewest"), most.alias("most"))


def long_shares(fact: DataFrame) -> DataFrame:
    """Band shares in long form: (band_label, measure, share)."""
    return band_summary(fact).unpivot(["band_label"], ["kwh_share", "amount_share"], "measure", "share")


def band_by_hour_wide(fact: DataFrame, bands: list[str]) -> DataFrame:
    """kWh per hour with one column a band."""
    return band_by_hour(fact).groupBy("source_hour").pivot("band_label", bands).agg(F.sum("kwh"))


def band_display(fact: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Per band, in band order: exact and displayed kWh, amount, both shares in percent and the mean price in pence.

    Each displayed value is rounded once from exact decimals; the price of the band is the least
    and greatest of its rows' prices.
    """
    g = fact.groupBy("band_label").agg(F.sum("consumption_kwh").alias("kwh"), F.sum("energy_charge_gbp").alias("amount_gbp"), F.min("price_pence_per_kwh").alias("least_pence"), F.max("price_pence_per_kwh").alias("greatest_pence"))
    all_ = Window.partitionBy(F.lit(1))  # over the few bands, after the aggregation
    k, a = displayed(F.col("kwh"), ENERGY), displayed(F.col("amount_gbp"), MONEY)
    return g.select(
        "band_label",
        band_order(F.col("band_label")).cast("bigint").alias("place"),
        k["exact"].alias("kwh_exact"),
        k["display"].alias("kwh_display"),
        a["exact"].alias("amount_exact"),
        a["display"].alias("amount_display"),
        share_percent(F.col("kwh"), F.sum("kwh").over(all_)).alias("kwh_percent"),
        share_percent(F.col("amount_gbp"), F.sum("amount_gbp").over(all_), scale=16).alias("amount_percent"),
        ratio(F.col("amount_gbp") * 100, F.col("kwh"), PRICE[1], 14).cast("decimal(20,3)").alias("pence_per_kwh"),
        "least_pence",
        "greatest_pence",
    )
