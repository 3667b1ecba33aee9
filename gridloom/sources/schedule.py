"""Sources of the band schedule and of prices, with their validation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The two columns of a schedule file.
HEADERS = ["TariffDateTime", "Tariff"]
SCHEDULE = "schedule_label_naive timestamp_ntz, schedule_label_text string, band_label string, schedule_year int, on_half_hour_grid boolean, schedule_source string, source_sha256 string, loaded_at_utc timestamp_ntz"
PRICES = "tariff_group string, band_label string, price_pence_per_kwh decimal(9,4), price_gbp_per_kwh decimal(9,6), currency string, price_unit string, effective_from date, effective_until date, evidence_label string, source_citation string, catalogue_version string"
VARIANTS = ("file", "demo")


class ScheduleError(ValueError):
    """A schedule that must not be used: it is refused, never repaired or replaced by another."""


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """(at, band) of a CSV or Parquet file with the two columns of ``HEADERS``; blank rows are skipped."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)
    if df.columns[:2] != HEADERS:
        raise ScheduleError(f"expected the columns {HEADERS}, found {df.columns}")
    text = F.col(HEADERS[0])
    at = text.try_cast("timestamp_ntz")
    rows = df.select(text.cast("string").alias("text"), at.alias("at"), F.trim(HEADERS[1]).alias("band"))
    return rows.where(F.col("text").isNotNull() | F.col("band").isNotNull())


def demo_schedule(spark: SparkSession, day: dt.date = dt.date(2030, 1, 1), special: dict[int, str] | None = None) -> DataFrame:
    """(text, at, band) of an invented day of 48 half-hours: ``special`` names bands by slot, all others are Normal."""
    special = {16: "Low", 36: "High"} if special is None else special
    at = F.lit(day).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 30).cast("int"))
    band = F.coalesce(*[F.when(F.col("id") == k, b) for k, b in special.items()], F.lit("Normal"))
    return spark.range(48).select(F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("text"), at.alias("at"), band.alias("band"))


def problems(rows: DataFrame) -> DataFrame:
    """(problem, rows, first): what is wrong with (text, at, band) rows, nothing for a sound schedule."""
    off = (F.minute("at") % 30 != 0) | (F.second("at") != 0)
    one = lambda name, bad: rows.where(bad).agg(F.count("*").alias("rows"), F.min("text").alias("first")).where("rows > 0").select(F.lit(name).alias("problem"), "rows", "first")
    twice = rows.where("at is not null").groupBy("at").agg(F.count("*").alias("n"), F.min("text").alias("text")).where("n > 1").agg(F.count("*").alias("rows"), F.min("text").alias("first")).where("rows > 0").select(F.lit("repeated label").alias("problem"), "rows", "first")
    empty = rows.agg(F.count("*").alias("rows")).where("rows = 0").select(F.lit("no rows").alias("problem"), "rows", F.lit(None).cast("string").alias("first"))
    return one("no instant", F.col("at").isNull()).unionByName(one("off the half-hour grid", F.coalesce(off, F.lit(False)))).unionByName(one("no band", F.coalesce(F.col("band"), F.lit("")) == "")).unionByName(twice).unionByName(empty)


def schedule_table(rows: DataFrame, source: str, sha256: str | None = None, loaded_at: dt.datetime | None = None) -> DataFrame:
    """The typed schedule of sound (text, at, band) rows; raises ``ScheduleError`` with all that is wrong."""
    wrong = problems(rows).collect()  # at most five rows
    if wrong:
        raise ScheduleError("; ".join(f"{r.problem}: {r['rows']} row(s), first {r['first']!r}" for r in wrong))
    return rows.select(
        F.col("at").alias("schedule_label_naive"),
        F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("schedule_label_text"),
        F.col("band").alias("band_label"),
        F.year("at").alias("schedule_year"),
        F.lit(True).alias("on_half_hour_grid"),
        F.lit(source).alias("schedule_source"),
        F.lit(sha256).cast("string").alias("source_sha256"),
        F.lit(loaded_at or dt.datetime.now(dt.UTC).replace(tzinfo=None)).cast("timestamp_ntz").alias("loaded_at_utc"),
    )


def resolve_schedule(spark: SparkSession, variant: str, path: str | None = None) -> DataFrame:
    """The schedule a name stands for. An unknown name is an error: invented data never stands in for a source's."""
    if variant == "demo":
        return schedule_table(demo_schedule(spark), "invented day")
    if variant == "file" and path:
        return schedule_table(read_schedule(spark, path), path)
    raise ScheduleError(f"unknown schedule {variant!r}, or no file given; expected one of {VARIANTS}")


def price_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Prices with their pounds exact from pence; of (group, band, pence, from, until, evidence, citation, version) rows.

    A price needs both bounds of its validity or neither; one without any is known but prices nothing.
    """
    half = [r[:2] for r in rows if (r[3] is None) != (r[4] is None)]
    if half or len({r[:2] + r[3:5] for r in rows}) != len(rows):
        raise ScheduleError(f"prices with half a validity {half} or given twice")
    df = spark.createDataFrame(rows, "tariff_group string, band_label string, price_pence_per_kwh decimal(9,4), effective_from date, effective_until date, evidence_label string, source_citation string, catalogue_version string")
    pounds = (F.col("price_pence_per_kwh") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(9,6)")
    return df.withColumns({"price_gbp_per_kwh": pounds, "currency": F.lit("GBP"), "price_unit": F.lit("kWh")}).select(*[c.split()[0] for c in PRICES.split(", ")])
