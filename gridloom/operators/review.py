"""Reports on a scope of households and dates: quality, days and what needs review.

A scope is a filter on the readings, so it goes to the scan, and every report of this package takes
a scoped table as it takes a whole one. All functions give no rows for empty tables unless stated.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import explore
from gridloom.operators.policy import LABEL, RAW_KEY, conflicting_labels, signature


def scoped(df: DataFrame, households: str | Sequence[str] | None = None, start: dt.date | None = None, end: dt.date | None = None, at: str = "observed_at_naive") -> DataFrame:
    """The rows of some households, all if none is named, whose date lies within start and end, both included and each open if null.

    Bounds compare instants, not dates computed from them, so they reach the scan. With a bound, rows without an instant are out.
    """
    if households is not None:
        df = df.where(F.col("household_id") == households if isinstance(households, str) else F.col("household_id").isin(*households))
    kind = df.schema[at].dataType.simpleString()
    if start is not None:
        df = df.where(F.col(at) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.where(F.col(at) < F.lit(end + dt.timedelta(days=1)).cast(kind))
    return df


def is_demo(df: DataFrame, prefix: str = "DEMO") -> DataFrame:
    """One row: rows, those of invented households (ids with the prefix), and whether all are."""
    demo = F.coalesce(F.startswith(F.col("household_id"), F.lit(prefix)), F.lit(False))
    return df.agg(F.count("*").alias("row_count"), F.count_if(demo).alias("demo_rows")).select("*", ((F.col("row_count") > 0) & (F.col("row_count") == F.col("demo_rows"))).alias("all_demo"))


def quality_record(readings: DataFrame) -> DataFrame:
    """One row of quality counters per household of a scope.

    Distinct readings are distinct as text; a label in ``equivalent_representations`` has several
    texts of one value, one in ``conflicting_keys`` several values. Gaps are steps over half an hour
    between on-grid labels of the scope.
    """
    per_text = readings.groupBy(*RAW_KEY, signature().alias("sig"), "value_category").agg(F.count("*").alias("n"), F.max((F.col("consumption_kwh") == 0).cast("int")).alias("zero"))
    n = F.col("n")
    total = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    category = F.coalesce("value_category", F.lit(""))
    per_raw = per_text.groupBy(*RAW_KEY).agg(
        F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.sum("n").alias("n"), total(category == "finite_numeric").alias("finite"), total(category == "null_token").alias("nulls"), total(F.coalesce("zero", F.lit(0)) == 1).alias("zeros")
    )
    conflict = F.coalesce(F.min("lo") != F.max("hi"), F.lit(False))
    texts = F.coalesce(F.min("consumption_raw_text") != F.max("consumption_raw_text"), F.lit(False))
    per_label = per_raw.groupBy(*LABEL).agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.sum("finite").alias("finite"), F.sum("nulls").alias("nulls"), F.sum("zeros").alias("zeros"), conflict.alias("conflict"), (~conflict & texts).alias("equivalent"))
    per = per_label.groupBy("household_id").agg(
        F.sum("n").alias("observed_records"),
        F.sum("texts").alias("distinct_readings"),
        (F.sum("n") - F.sum("texts")).alias("duplicates_removed"),
        F.count_if("equivalent").alias("equivalent_representations"),
        F.sum("finite").alias("finite_values"),
        F.sum("nulls").alias("null_tokens"),
        (F.sum("n") - F.sum("finite") - F.sum("nulls")).alias("other_non_numeric"),
        F.sum("zeros").alias("zero_values"),
        F.count_if(F.col("n") > 1).alias("candidate_key_collisions"),
        F.count_if("conflict").alias("conflicting_keys"),
        (F.count_if("conflict") + F.count_if("equivalent")).alias("repeated_timestamps"),
    )
    gaps = explore.step_gaps(readings).groupBy("household_id").agg(F.count("*").alias("gaps"))
    off = explore.off_grid_rows(readings).groupBy("household_id").agg(F.count("*").alias("off_grid_observations"))
    members = readings.select("household_id", "member_name").distinct().groupBy("household_id").agg(F.count("member_name").alias("members"))
    out = per
    for more in (gaps, off, members):
        out = out.join(more.withColumnRenamed("household_id", "h"), F.col("household_id").eqNullSafe(F.col("h")), "left").drop("h")
    return out.fillna(0, ["gaps", "off_grid_observations"])


def review_status(quality: DataFrame) -> DataFrame:
    """(household_id, level, items, detail) of quality records: blocking, review or clear.

    Items are missing values, gaps, conflicting labels and off-grid readings together; one row may
    count under several. Repeats the policy resolves are no items.
    """
    counts = {"null_tokens": "missing value(s)", "gaps": "gap(s)", "conflicting_keys": "conflicting timestamp(s)", "off_grid_observations": "off-grid reading(s)"}
    items = sum((F.col(c) for c in list(counts)[1:]), F.col("null_tokens"))
    level = F.when(F.col("conflicting_keys") > 0, "blocking").when(items > 0, "review").otherwise("clear")
    said = F.filter(F.array(*[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {text}"))) for c, text in counts.items()]), lambda x: x.isNotNull())
    return quality.select("household_id", level.alias("level"), items.alias("items"), F.array_join(said, ", ").alias("detail"))


def day_report(readings: DataFrame) -> DataFrame:
    """The daily totals with gaps, equivalent labels, contributing readings and the day's status.

    Status: ``conflicting readings``, ``no readings recorded``, ``for review`` (rows but nothing to
    total, missing values or gaps), ``boundary date`` or ``recorded``. A gap belongs to its later date.
    """
    days = explore.daily_totals(readings)
    gaps = explore.step_gaps(readings).groupBy("household_id", F.col("attributed_date").alias("source_date")).agg(F.count("*").alias("gaps_observed"))
    dated = readings.where(F.col("observed_at_naive").isNotNull() & F.col("household_id").isNotNull())
    labels = dated.groupBy("household_id", F.to_date("observed_at_naive").alias("source_date"), "source_timestamp_text").agg(
        F.min(signature()).alias("lo"), F.max(signature()).alias("hi"), F.min("consumption_raw_text").alias("t0"), F.max("consumption_raw_text").alias("t1"), F.max(F.coalesce("on_half_hour_grid", F.lit(False)) & F.col("consumption_kwh").isNotNull()).alias("on_grid")
    )
    per = labels.groupBy("household_id", "source_date").agg(F.count_if((F.col("lo") == F.col("hi")) & (F.col("t0") != F.col("t1"))).alias("equivalent_representations"), F.count_if("on_grid").alias("grid_readings"))
    x = days.join(gaps, ["household_id", "source_date"], "left").join(per, ["household_id", "source_date"], "left").fillna(0, ["gaps_observed", "equivalent_representations", "grid_readings"])
    status = (
        F.when(F.col("has_conflict"), "conflicting readings")
        .when(F.col("total_status") == "none", F.when(F.col("has_rows"), "for review").otherwise("no readings recorded"))
        .when(F.col("is_boundary_day"), "boundary date")
        .when((F.col("missing_values") > 0) | (F.col("gaps_observed") > 0), "for review")
        .otherwise("recorded")
    )
    contributing = F.when(F.col("total_status") == "published", F.col("grid_readings")).otherwise(0)
    return x.select(*days.columns, "gaps_observed", "equivalent_representations", contributing.cast("bigint").alias("contributing_readings"), status.alias("status"))


def conflict_rows(readings: DataFrame) -> DataFrame:
    """All raw rows at labels whose readings disagree, with where each stood."""
    found = conflicting_labels(readings)
    kept = readings.select(*LABEL, "archive_name", "member_name", "source_record_no", "consumption_raw_text", "value_category", "consumption_kwh")
    return kept.join(found, LABEL, "left_semi")


def repeat_examples(readings: DataFrame, limit: int = 5, conflicting: bool = False) -> DataFrame:
    """Labels with most rows, or among those whose readings disagree; ties by household and label. The limit is the feature."""
    g = readings.where(F.col("household_id").isNotNull() & F.col("source_timestamp_text").isNotNull()).groupBy(*LABEL).agg(F.count("*").alias("row_count"), F.min("source_record_no").alias("first_record_no"), F.coalesce(F.min(signature()) != F.max(signature()), F.lit(False)).alias("conflicting"))
    g = g.where(F.col("conflicting") if conflicting else F.col("row_count") > 1)
    return g.select(*LABEL, "row_count", "first_record_no").orderBy(F.desc("row_count"), *LABEL).limit(limit)


def distinct_lists(readings: DataFrame, fact: DataFrame) -> DataFrame:
    """(list, value): households, their tariff groups, charged households and assumptions, each once."""
    one = lambda df, name, c: df.where(F.col(c).isNotNull()).select(F.lit(name).alias("list"), F.col(c).alias("value")).distinct()
    return one(readings, "households", "household_id").unionByName(one(readings, "tariff_groups", "tariff_group")).unionByName(one(fact, "charged_households", "household_id")).unionByName(one(fact, "assumptions", "assumption_id"))


def household_order(totals: DataFrame, by: str = "amount_gbp", limit: int | None = None) -> DataFrame:
    """Household totals from the smallest value of a column up, ids breaking ties; ``limit`` takes the first."""
    ordered = totals.orderBy(F.col(by).asc_nulls_last(), "household_id")
    return ordered.limit(limit) if limit is not None else ordered
