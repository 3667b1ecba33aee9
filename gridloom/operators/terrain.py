"""A dense date by half-hour grid of a year: cells, margins and peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.display import share_percent


def fact_cells(fact: DataFrame) -> DataFrame:
    """Pooled per (date, slot of 48): rows, households, kWh, amount, and whether bands contradict."""
    at = F.col("observed_at_naive")
    slot = (F.hour(at) * 2 + F.floor(F.minute(at) / 30)).cast("bigint")
    return fact.where(at.isNotNull()).groupBy("source_date", slot.alias("slot")).agg(
        F.count("*").alias("row_count"),
        F.countDistinct("household_id").alias("households"),
        F.sum("consumption_kwh").alias("kwh"),
        F.sum("energy_charge_gbp").alias("amount_gbp"),
        F.coalesce(F.min("band_label") != F.max("band_label"), F.lit(False)).alias("contradicts"),
        F.count_if((F.minute(at) % 30 != 0) | (F.second(at) != 0)).alias("irregular"),
    )


def schedule_cells(schedule: DataFrame) -> DataFrame:
    """The schedule per (date, slot).

    Two bands at one slot are an error when the cells are read: which of them holds is not for this engine to choose.
    """
    at = F.col("schedule_label_naive")
    slot = (F.hour(at) * 2 + F.floor(F.minute(at) / 30)).cast("bigint")
    return schedule.groupBy(F.to_date(at).alias("source_date"), slot.alias("slot")).agg(
        F.when(F.min("band_label") == F.max("band_label"), F.min("band_label")).when(F.count("band_label") > 0, F.raise_error(F.concat(F.lit("contradictory bands at "), F.min(at).cast("string")))).alias("band_label")
    )


def dense_cells(fact: DataFrame, schedule: DataFrame) -> DataFrame:
    """Every (date, slot) of the schedule's dates, null measures where nothing was read.

    ``cell`` counts date-major from the first date. A recorded 0 stays 0; an empty cell stays null.
    """
    span = schedule.agg(F.to_date(F.min("schedule_label_naive")).alias("lo"), F.to_date(F.max("schedule_label_naive")).alias("hi"))
    grid = span.select("lo", F.explode(F.sequence("lo", "hi")).alias("source_date")).select("lo", "source_date", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(47).cast("bigint"))).alias("slot"))
    joined = grid.join(schedule_cells(schedule), ["source_date", "slot"], "left").join(fact_cells(fact), ["source_date", "slot"], "left")
    cell = F.datediff("source_date", "lo").cast("bigint") * 48 + F.col("slot")
    return joined.select(cell.alias("cell"), "source_date", "slot", "band_label", F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("households", F.lit(0)).alias("households"), "kwh", "amount_gbp")


def by_band(cells: DataFrame) -> DataFrame:
    return cells.groupBy("band_label").agg(F.count("*").alias("slots"), F.count_if(F.col("row_count") > 0).alias("covered_slots"), F.sum("kwh").alias("kwh"), F.sum("amount_gbp").alias("amount_gbp"))


def by_month(cells: DataFrame) -> DataFrame:
    return cells.groupBy(F.month("source_date").cast("bigint").alias("month")).agg(F.sum("row_count").alias("row_count"), F.min("households").alias("least_households"), F.max("households").alias("most_households"), F.sum("kwh").alias("kwh"), F.sum("amount_gbp").alias("amount_gbp"))


def peaks(cells: DataFrame) -> DataFrame:
    """The cell with most kWh and that with the largest amount; the smallest cell of equals."""
    best = lambda c: F.max_by(F.struct("cell", "source_date", "slot", F.col(c).cast("decimal(38,16)").alias("value")), F.struct(F.col(c), (-F.col("cell")).alias("early")))
    one = lambda c: cells.where(F.col(c).isNotNull()).agg(best(c).alias("b")).where("b is not null").select(F.lit(c).alias("measure"), "b.*")
    return one("kwh").unionByName(one("amount_gbp"))


def day_rows(cells: DataFrame) -> DataFrame:
    """One row a date with its 48 slots as an array in slot order, nulls kept."""
    return cells.groupBy("source_date").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "kwh"))), lambda s: s["kwh"]).alias("kwh_by_slot"))


def hour_concentration(schedule: DataFrame, band: str = "High") -> DataFrame:
    """Slots of a band per hour with their share and running share from the fullest hour down."""
    hours = schedule.where(F.col("band_label") == band).groupBy(F.hour("schedule_label_naive").cast("bigint").alias("hour")).agg(F.count("*").alias("slots"))
    all_ = Window.partitionBy(F.lit(1))  # at most 24 rows
    down = all_.orderBy(F.desc("slots"), "hour")
    return hours.select("hour", "slots", F.sum("slots").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(down).cast("bigint").alias("place"), F.sum("slots").over(all_).alias("all_slots"))


def checks(cells: DataFrame, fact: DataFrame, schedule: DataFrame) -> DataFrame:
    """(check, left, right, holds): what must agree between the grid, its margins and the fact, exactly.

    Counts and sums of the cells against those of the fact, the margins by band and by month
    against the cells, the cells against dates times slots, and the slots of a band against the
    schedule. The cells number at most 48 a day, so all but the sums over the fact are small.
    """
    text = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    kwh, amount = (lambda c, n=n: text(F.sum(c).cast(f"decimal(38,{n})")) for n in (10, 16))
    c = cells.agg(text(F.sum("row_count")).alias("rows"), kwh("kwh").alias("kwh"), amount("amount_gbp").alias("amount"), F.count("*").cast("string").alias("cells"), (F.count_distinct("source_date") * 48).cast("string").alias("expected"), F.count("band_label").cast("string").alias("banded"))
    f = fact.where(F.col("observed_at_naive").isNotNull()).agg(F.count("*").cast("string").alias("f_rows"), kwh("consumption_kwh").alias("f_kwh"), amount("energy_charge_gbp").alias("f_amount"))
    band = by_band(cells).agg(kwh("kwh").alias("b_kwh"), amount("amount_gbp").alias("b_amount"))
    month = by_month(cells).agg(text(F.sum("row_count")).alias("m_rows"), kwh("kwh").alias("m_kwh"))
    slots = schedule_cells(schedule).where("band_label is not null").agg(F.count("*").cast("string").alias("s_slots"))
    of = lambda df, name: df.select(name).scalar()
    pairs = {
        "rows": (F.col("rows"), of(f, "f_rows")), "kwh": (F.col("kwh"), of(f, "f_kwh")), "amount": (F.col("amount"), of(f, "f_amount")),
        "band_kwh": (of(band, "b_kwh"), F.col("kwh")), "band_amount": (of(band, "b_amount"), F.col("amount")), "month_rows": (of(month, "m_rows"), F.col("rows")),
        "month_kwh": (of(month, "m_kwh"), F.col("kwh")), "cells": (F.col("cells"), F.col("expected")), "banded_slots": (F.col("banded"), of(slots, "s_slots")),
    }
    rows = c.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), a.alias("left"), b.alias("right")) for n, (a, b) in pairs.items()])))
    return rows.withColumn("holds", F.col("left").eqNullSafe(F.col("right")))


def high_hours(schedule: DataFrame, band: str = "High") -> DataFrame:
    """One row: the hours with most slots of a band, from the first to the last, with their share and whether they are one run.

    No row if the band has no slot.
    """
    hours = schedule.where(F.col("band_label") == band).groupBy(F.hour("schedule_label_naive").cast("bigint").alias("hour")).agg(F.count("*").alias("slots"))
    one = hours.agg(F.array_sort(F.collect_list(F.struct("hour", "slots"))).alias("h"), F.max("slots").alias("most"), F.sum("slots").alias("total")).where("total > 0")
    top = F.filter("h", lambda x: x["slots"] == F.col("most"))
    one = one.select(top.alias("top"), "total", F.size("h").alias("hours_used"), "most")
    held = F.size("top") * F.col("most")
    return one.select(
        F.col("top")[0]["hour"].alias("from_hour"), F.element_at("top", -1)["hour"].alias("to_hour"), held.alias("slots"), "total",
        share_percent(held, F.col("total")).alias("percent"), (F.element_at("top", -1)["hour"] - F.col("top")[0]["hour"] + 1 == F.size("top")).alias("contiguous"), (F.col("hours_used") == 24).alias("every_hour"),
    )
