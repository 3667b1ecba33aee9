"""Row identity, repeats and disagreements between readings.

Two identities are kept apart: raw-text identity (``RAW_KEY``) and value identity, in which a
value's signature is its decimal at fixed scale, else ``~`` and its category. Null keys group as
equals; all functions give no rows, or zero counts, for empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW_KEY = ["household_id", "tariff_group", "source_timestamp_text", "consumption_raw_text"]
LABEL = ["household_id", "source_timestamp_text"]
DISTINCT_COLUMNS = ["household_id", "tariff_group", "source_timestamp_text", "observed_at_naive", "on_half_hour_grid", "consumption_kwh", "value_category"]


def signature(value: str = "consumption_kwh", category: str = "value_category") -> Column:
    """Decimal text at fixed scale, else ``~`` and the category."""
    return F.coalesce(F.col(value).cast("string"), F.concat(F.lit("~"), F.col(category)))


def joined(col: str) -> Column:
    """Distinct values of a group as one text, sorted."""
    return F.array_join(F.array_sort(F.collect_set(col)), " | ")


def distinct_readings(readings: DataFrame) -> DataFrame:
    """The accounting unit: readings equal in all parsed columns and signature, once each."""
    return readings.select(*DISTINCT_COLUMNS, signature().alias("value_signature")).distinct()


def distinct_raw_readings(readings: DataFrame) -> DataFrame:
    """Readings equal as raw text, once each."""
    return readings.select(*RAW_KEY).distinct()


def key_collisions(readings: DataFrame) -> DataFrame:
    """Labels with more than one row: rows, distinct signatures and members involved."""
    return (
        readings.select(*LABEL, "member_name", signature().alias("sig"))
        .groupBy(*LABEL)
        .agg(F.count("*").alias("row_count"), F.countDistinct("sig").alias("distinct_signatures"), F.countDistinct("member_name").alias("members"))
        .where("row_count > 1")
    )


def conflicting_labels(readings: DataFrame) -> DataFrame:
    """Labels of a household whose readings carry more than one signature.

    The smallest and largest signature tell as much as a distinct count and aggregate map-side.
    """
    return (
        readings.select(*LABEL, signature().alias("sig")).groupBy(*LABEL).agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi").select(*LABEL)
    )


def exact_duplicates(readings: DataFrame) -> DataFrame:
    """Raw-text groups with more than one row, and the rows beyond the first."""
    return readings.groupBy(*RAW_KEY).agg(F.count("*").alias("row_count")).where("row_count > 1").withColumn("extra_rows", F.col("row_count") - 1)


def household_coverage(readings: DataFrame) -> DataFrame:
    """Per household: rows, members, label span and values by category."""
    return readings.groupBy("household_id").agg(
        F.count("*").alias("row_count"),
        F.countDistinct("member_name").alias("members"),
        F.min("source_timestamp_text").alias("first_label"),
        F.max("source_timestamp_text").alias("last_label"),
        F.count_if(F.col("value_category") == "finite_numeric").alias("finite_values"),
        F.count_if(F.col("value_category") == "null_token").alias("null_values"),
        F.count_if(F.col("consumption_kwh") == 0).alias("zero_values"),
    )


def label_agreement(readings: DataFrame) -> DataFrame:
    """Repeated labels: how their rows agree, where they first stood, and the kind of repeat.

    kind is ``conflict`` (several signatures), ``equivalent_representation`` (several texts of one
    signature) or ``exact_duplicate``.
    """
    distinct = (
        readings.select(*LABEL, "member_name", "source_record_no", F.col("consumption_raw_text").alias("text"), signature().alias("sig"))
        .groupBy(*LABEL, "text", "sig", "member_name")
        .agg(F.count("*").alias("n"), F.min("source_record_no").alias("no"))
    )
    # Distinct values meet map-side in sets: a label's texts are few, and repeats are gone by now.
    g = (
        distinct.groupBy(*LABEL)
        .agg(
            F.sum("n").alias("rows_raw"),
            F.size(F.collect_set("text")).cast("bigint").alias("distinct_texts"),
            F.size(F.collect_set("sig")).cast("bigint").alias("distinct_signatures"),
            F.size(F.collect_set("member_name")).cast("bigint").alias("members_involved"),
            F.min("member_name").alias("first_member"),
            F.min("no").alias("first_record_no"),
            joined("text").alias("texts"),
        )
        .where("rows_raw > 1")
    )
    kind = F.when(F.col("distinct_signatures") > 1, "conflict").when(F.col("distinct_texts") > 1, "equivalent_representation").otherwise("exact_duplicate")
    return g.withColumn("kind", kind)


def dataset_summary(readings: DataFrame) -> DataFrame:
    """One row on a whole table: rows, households with and without the variable group, members, label span."""
    per = readings.groupBy("household_id", "member_name").agg(F.count("*").alias("n"), F.max((F.coalesce("tariff_group", F.lit("")) == "ToU").cast("int")).alias("v"), F.min("observed_at_naive").alias("a"), F.max("observed_at_naive").alias("b"))
    houses = per.groupBy("household_id").agg(F.max("v").alias("v")).where(F.col("household_id").isNotNull()).agg(F.count("*").alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    members = per.select("member_name").distinct().agg(F.count("member_name"))
    # Rows come down to households and members before anything is counted as distinct.
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.min("a").alias("first_at"), F.max("b").alias("last_at")
    ).select("row_count", houses.select("n").scalar().alias("households"), houses.select("v").scalar().alias("variable_households"), members.scalar().alias("members"), "first_at", "last_at")


def quality_summary(readings: DataFrame) -> DataFrame:
    """One row of quality counters per household.

    Counts of raw rows, distinct readings, repeats removed, values by category, collisions,
    conflicts and off-grid rows. A first aggregation by label and text meets each key once; the
    second only counts, so nothing is shuffled twice at full size.
    """
    per_text = (
        readings.select("household_id", "source_timestamp_text", "tariff_group", F.col("consumption_raw_text").alias("text"), signature().alias("sig"), "value_category", "consumption_kwh", "on_half_hour_grid")
        .groupBy("household_id", "source_timestamp_text", "tariff_group", "text", "sig", "value_category", "on_half_hour_grid")
        .agg(F.count("*").alias("n"), F.max((F.col("consumption_kwh") == 0).cast("int")).alias("zero"))
    )
    per_label = per_text.groupBy("household_id", "source_timestamp_text").agg(
        F.sum("n").alias("n"),
        F.countDistinct(F.struct("tariff_group", "sig")).alias("signatures"),
        (F.min("sig") != F.max("sig")).alias("conflict"),
        F.sum(F.when(F.col("value_category") == "finite_numeric", F.col("n")).otherwise(0)).alias("finite"),
        F.sum(F.when(F.col("value_category") == "null_token", F.col("n")).otherwise(0)).alias("nulls"),
        F.sum(F.when(F.coalesce("zero", F.lit(0)) == 1, F.col("n")).otherwise(0)).alias("zeros"),
        F.sum(F.when(F.coalesce("on_half_hour_grid", F.lit(False)), 0).otherwise(F.col("n"))).alias("off"),
        F.sum(F.col("n") - 1).alias("extras"),
    )
    return per_label.groupBy("household_id").agg(
        F.sum("n").alias("observed_records"),
        F.sum("signatures").alias("distinct_readings"),
        F.sum("extras").alias("exact_duplicate_extras"),
        F.sum("finite").alias("finite_values"),
        F.sum("nulls").alias("null_values"),
        F.sum("zeros").alias("zero_values"),
        F.sum("off").alias("off_grid_rows"),
        F.count_if(F.col("n") > 1).alias("colliding_labels"),
        F.count_if(F.col("conflict")).alias("conflicting_labels"),
    )


def group_stability(readings: DataFrame) -> DataFrame:
    """Households seen with more than one tariff group, with the groups joined."""
    return readings.groupBy("household_id").agg(F.countDistinct("tariff_group").alias("groups"), joined("tariff_group").alias("seen")).where("groups > 1")


def exact_totals(readings: DataFrame) -> DataFrame:
    """Per household: exact sum over distinct (label, value) pairs that are finite and on the grid."""
    return (
        readings.where(F.col("consumption_kwh").isNotNull() & F.col("on_half_hour_grid"))
        .select("household_id", "source_timestamp_text", "consumption_kwh")
        .distinct()
        .groupBy("household_id")
        .agg(F.sum("consumption_kwh").alias("total_kwh"), F.count("*").alias("readings"))
    )


def observations_page(readings: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of readings in the total order (instant, record number, member); a page is the feature."""
    return (
        readings.select("household_id", "observed_at_naive", "source_record_no", "member_name", "consumption_raw_text")
        .orderBy(F.col("observed_at_naive").asc_nulls_last(), F.col("source_record_no").asc_nulls_last(), F.col("member_name").asc_nulls_last())
        .offset(offset)
        .limit(limit)
    )


def latest_loads(registry: DataFrame) -> DataFrame:
    """The latest published load of each archive member; ties go to the larger load_id."""
    best = F.max_by(F.struct("load_id", "loaded_at_utc", "records_published"), F.struct("loaded_at_utc", "load_id"))
    return registry.where("status = 'published'").groupBy("archive_name", "member_name").agg(best.alias("b")).select("archive_name", "member_name", "b.*")
