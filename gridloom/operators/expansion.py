"""What a larger set of members adds to, takes from and changes in a smaller one, to an exact balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.policy import conflicting_labels, signature

LABEL = ["household_id", "source_timestamp_text"]


def settled(readings: DataFrame) -> DataFrame:
    """(household_id, source_timestamp_text, kwh): labels with one numeric signature and no dispute."""
    g = readings.where(F.col("household_id").isNotNull() & F.col("source_timestamp_text").isNotNull()).select(*LABEL, signature().alias("sig"), "consumption_kwh")
    g = g.groupBy(*LABEL).agg((F.min("sig") == F.max("sig")).alias("one"), F.max("consumption_kwh").alias("kwh"))
    return g.where("one and kwh is not null").select(*LABEL, "kwh")


def added(base: DataFrame, wider: DataFrame) -> DataFrame:
    return settled(wider).join(settled(base), LABEL, "left_anti")


def removed(base: DataFrame, wider: DataFrame) -> DataFrame:
    return settled(base).join(settled(wider), LABEL, "left_anti")


def changed(base: DataFrame, wider: DataFrame) -> DataFrame:
    b = settled(base).withColumnRenamed("kwh", "base_kwh")
    return settled(wider).join(b, LABEL).where("kwh <> base_kwh")


def reconciliation(base: DataFrame, wider: DataFrame) -> DataFrame:
    """Per household: base + added - removed + changed = wider, with the residual, in one full outer join."""
    b, w = settled(base).withColumnRenamed("kwh", "b"), settled(wider).withColumnRenamed("kwh", "w")
    both = b.join(w, LABEL, "full_outer")
    zero = F.lit(0).cast("decimal(38,10)")
    total = lambda cond, col: F.coalesce(F.sum(F.when(cond, col)), zero).cast("decimal(38,10)")
    only_w, only_b = F.col("b").isNull(), F.col("w").isNull()
    always = F.lit(True)
    out = both.groupBy("household_id").agg(
        total(always, F.col("b")).alias("base_kwh"),
        total(only_w, F.col("w")).alias("added_kwh"),
        total(only_b, F.col("b")).alias("removed_kwh"),
        total(~only_w & ~only_b, F.col("w") - F.col("b")).alias("changed_kwh"),
        total(always, F.col("w")).alias("wider_kwh"),
    )
    return out.withColumn("residual", (F.col("base_kwh") + F.col("added_kwh") - F.col("removed_kwh") + F.col("changed_kwh") - F.col("wider_kwh")).cast("decimal(38,10)"))


def new_conflicts(base: DataFrame, wider: DataFrame) -> DataFrame:
    """Labels in conflict in the wider set only."""
    return conflicting_labels(wider).subtract(conflicting_labels(base))


def resolved_conflicts(base: DataFrame, wider: DataFrame) -> DataFrame:
    return conflicting_labels(base).subtract(conflicting_labels(wider))


def ladder(base: DataFrame, wider: DataFrame) -> DataFrame:
    """(side, row_count, distinct_readings, households, members): the two sets side by side."""

    def one(df: DataFrame, side: str) -> DataFrame:
        per = df.groupBy(*LABEL, signature().alias("sig"), "member_name").agg(F.count("*").alias("n"))
        houses = per.select("household_id").distinct().agg(F.count("household_id"))
        members = per.select("member_name").distinct().agg(F.count("member_name"))
        readings = per.groupBy(*LABEL, "sig").agg(F.sum("n").alias("n"))
        return readings.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count("*").alias("distinct_readings")).select(F.lit(side).alias("side"), "*", houses.scalar().alias("households"), members.scalar().alias("members"))

    return one(base, "base").unionByName(one(wider, "wider"))


def removed_sources(base: DataFrame, wider: DataFrame) -> DataFrame:
    """Why a label the smaller set had settled is settled no more: its reason and each row the larger set holds at it.

    Reasons: ``conflict``, ``no_number`` or ``absent`` (then without rows), one row a source row.
    """
    gone = removed(base, wider).select(*LABEL, F.col("kwh").alias("base_kwh"))
    held = wider.where(F.col("household_id").isNotNull() & F.col("source_timestamp_text").isNotNull())
    now = held.groupBy(*LABEL).agg((F.min(signature()) != F.max(signature())).alias("conflict"))
    judged = gone.join(now, LABEL, "left").withColumn("reason", F.when(F.col("conflict").isNull(), "absent").when(F.col("conflict"), "conflict").otherwise("no_number"))
    rows = held.select(*LABEL, "member_name", "source_record_no", "consumption_raw_text", "value_category")
    return judged.drop("conflict").join(rows, LABEL, "left")


def reason_counts(base: DataFrame, wider: DataFrame) -> DataFrame:
    """(kind, reason, labels, kwh): added, removed by reason and changed labels, with what each adds to the total."""
    zero = F.lit(0).cast("decimal(38,10)")
    plus = added(base, wider).select(F.lit("added").alias("kind"), F.lit("settled").alias("reason"), F.col("kwh").alias("d"))
    minus = removed_sources(base, wider).select(*LABEL, "reason", "base_kwh").distinct().select(F.lit("removed").alias("kind"), "reason", (-F.col("base_kwh")).alias("d"))
    moved = changed(base, wider).select(F.lit("changed").alias("kind"), F.lit("value").alias("reason"), (F.col("kwh") - F.col("base_kwh")).alias("d"))
    return plus.unionByName(minus).unionByName(moved).groupBy("kind", "reason").agg(F.count("*").alias("labels"), F.coalesce(F.sum("d"), zero).cast("decimal(38,10)").alias("kwh"))


def report(base: DataFrame, wider: DataFrame) -> dict[str, DataFrame]:
    """The sections of a comparison of two sets, by name; ``bundles.write_report`` turns them into files."""
    return {
        "ladder": ladder(base, wider),
        "reasons": reason_counts(base, wider),
        "reconciliation": reconciliation(base, wider),
        "removed_sources": removed_sources(base, wider),
        "supplied_by": supplied_by(base, wider),
        "new_households": new_households(base, wider),
        "repeated_readings": repeated_readings(base, wider),
        "new_conflicts": new_conflicts(base, wider),
        "resolved_conflicts": resolved_conflicts(base, wider),
    }


def supplied_by(base: DataFrame, wider: DataFrame) -> DataFrame:
    """Which member supplied each household's added labels, in one join instead of one query a household."""
    new = added(base, wider).select(*LABEL)
    return wider.select(*LABEL, "member_name").join(new, LABEL).groupBy("household_id", "member_name").agg(F.countDistinct("source_timestamp_text").alias("labels"))


def new_households(base: DataFrame, wider: DataFrame) -> DataFrame:
    return wider.select("household_id").distinct().join(base.select("household_id").distinct(), "household_id", "left_anti").where(F.col("household_id").isNotNull())


def repeated_readings(base: DataFrame, wider: DataFrame) -> DataFrame:
    """Rows of members outside the base that repeat a reading the base already has, per member."""
    key = [*LABEL, "sig"]
    known = base.select(*LABEL, signature().alias("sig"))
    extra = wider.join(base.select("member_name").distinct(), "member_name", "left_anti").select(*LABEL, "member_name", signature().alias("sig"))
    return extra.join(known, key, "left_semi").groupBy("member_name").agg(F.count("*").alias("row_count"))
