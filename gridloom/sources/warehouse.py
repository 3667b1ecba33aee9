"""A folder warehouse of Parquet tables with member-scoped, repeatable loads.

Rows lie in one partition a load; the registry, appended last, says which load of a member counts.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import pathlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.text import strip
from gridloom.operators.profile import value_category
from gridloom.operators.rejects import _number_reason, _timestamp_reason
from gridloom.sources import members

REGISTRY = "load_id string, archive_name string, member_name string, member_content_sha256 string, pipeline_fingerprint string, loaded_at_utc timestamp_ntz, records_read bigint, records_published bigint, records_rejected bigint, status string, problem string, superseded_at_utc timestamp_ntz"


def pipeline_fingerprint() -> str:
    """SHA-256 over this package's sources: a changed rule makes a member load again."""
    root = pathlib.Path(__file__).resolve().parent.parent
    h = hashlib.sha256()
    for p in sorted(root.rglob("*.py")):
        if "llm" not in p.relative_to(root).parts:
            h.update(str(p.relative_to(root)).encode() + b"\0" + p.read_bytes() + b"\0")
    return h.hexdigest()


def judged_records(records: DataFrame) -> DataFrame:
    """Parsed records with the reason they are rejected for, or null: header, field count, label, then value."""
    four = F.size("fields") == 4
    stamp, amount = F.get("fields", F.lit(2)), F.get("fields", F.lit(3))
    reason = F.when(F.col("source_record_no") == 0, "unexpected_header").when(~F.col("complete"), "unreadable").when(~four, "wrong_field_count").otherwise(F.coalesce(_timestamp_reason(stamp), _number_reason(amount)))
    return records.withColumn("reason", reason)


def published(judged: DataFrame) -> DataFrame:
    """The typed readings of accepted records."""
    raw = F.col("fields")[3]
    at = F.substring(F.col("fields")[2], 1, 26).try_cast("timestamp_ntz")
    text = F.replace(strip(raw), F.lit("_"), F.lit(""))
    category = value_category(raw)
    return judged.where("reason is null").select(
        "load_id",
        "archive_name",
        "member_name",
        "source_record_no",
        F.col("fields")[0].alias("household_id"),
        F.col("fields")[1].alias("tariff_group"),
        F.col("fields")[2].alias("source_timestamp_text"),
        at.alias("observed_at_naive"),
        (F.minute(at).isin(0, 30) & (F.second(at) == 0) & (F.substring(F.col("fields")[2], 21, 6) == "000000")).alias("on_half_hour_grid"),
        F.when(category == "finite_numeric", text).try_cast("decimal(28,10)").alias("consumption_kwh"),
        raw.alias("consumption_raw_text"),
        category.alias("value_category"),
    )


def registry(spark: SparkSession, root: str) -> DataFrame:
    """All loads so far; empty before the first.

    The stored rows are only ever appended. A published load that a later one of its member has
    replaced reads as ``superseded``, since the moment that one was loaded.
    """
    try:
        rows = spark.read.schema(REGISTRY).parquet(f"{root}/load_registry")
    except AnalysisException:
        return spark.createDataFrame([], REGISTRY)
    later = F.lead(F.when(F.col("status") == "published", F.col("loaded_at_utc")), 1).over(Window.partitionBy("archive_name", "member_name", "status").orderBy("loaded_at_utc", "load_id"))
    return rows.withColumn("superseded_at_utc", later).withColumn("status", F.when(F.col("superseded_at_utc").isNotNull(), "superseded").otherwise(F.col("status")))


def current(spark: SparkSession, root: str) -> DataFrame:
    """(load_id) of the latest published load of each member."""
    return registry(spark, root).where("status = 'published'").select("load_id")


def load(spark: SparkSession, archives: str, root: str, now: dt.datetime | None = None) -> DataFrame:
    """Load the members that changed since their last load; returns the new registry rows.

    A load's id is the digest of its member's bytes and of the code, and names its partition: a load
    broken off half way is done again in the same place, and readers see a member change at once,
    when the registry names the new load. A member that cannot be read to its end, or whose header
    is not the contract's, publishes nothing; its registry row says why.
    Loading the same bytes by the same code again does nothing.
    """
    code, parts = pipeline_fingerprint(), ["archive_name", "member_name"]
    tallies = members.member_tallies(spark, archives).select(*parts, F.col("sha256").alias("member_content_sha256"))
    tallies = tallies.withColumn("load_id", F.concat(F.lit("load-"), F.substring(F.sha2(F.concat_ws("|", *parts, "member_content_sha256", F.lit(code)), 256), 1, 20)))
    known = registry(spark, root).groupBy(*parts).agg(F.max_by("load_id", F.struct("loaded_at_utc", "load_id")).alias("load_id"))
    counts = None
    todo = tallies.join(known, [*parts, "load_id"], "left_anti").cache()
    try:
        if todo.isEmpty():
            return spark.createDataFrame([], REGISTRY)
        judged = judged_records(members.read_records(spark, archives)).join(todo.select(*parts, "load_id"), parts)
        counts = judged.groupBy("load_id").agg(F.count_if(F.col("source_record_no") > 0).alias("n"), F.count_if(F.col("reason").isNull()).alias("ok"), F.max(~F.col("complete")).alias("failed"), F.min("problem").alias("problem")).cache()
        whole = judged.join(counts.where("failed").select("load_id"), "load_id", "left_anti")
        write = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load_id").parquet(f"{root}/{name}")
        write(published(whole), "readings")
        write(whole.where("reason is not null").select("load_id", *parts, "source_record_no", "reason", F.array_join("fields", "|").alias("source_fields")), "rejected_records")
        failed, n, ok = F.coalesce("failed", F.lit(False)), F.coalesce("n", F.lit(0)), F.coalesce("ok", F.lit(0))
        rows = todo.join(counts, "load_id", "left").select(
            "load_id",
            *parts,
            "member_content_sha256",
            F.lit(code).alias("pipeline_fingerprint"),
            F.lit(now or dt.datetime.now(dt.UTC).replace(tzinfo=None)).cast("timestamp_ntz").alias("loaded_at_utc"),
            n.alias("records_read"),
            F.when(failed, 0).otherwise(ok).cast("bigint").alias("records_published"),
            F.when(failed, 0).otherwise(n - ok).cast("bigint").alias("records_rejected"),
            F.when(failed, "failed").otherwise("published").alias("status"),
            "problem",
            F.lit(None).cast("timestamp_ntz").alias("superseded_at_utc"),
        )
        fresh = spark.createDataFrame(rows.collect(), REGISTRY)  # one row a member of this load
        fresh.write.mode("append").parquet(f"{root}/load_registry")
        return fresh
    finally:
        todo.unpersist()
        if counts is not None:
            counts.unpersist()


def readings(spark: SparkSession, root: str, name: str = "readings") -> DataFrame:
    """The rows of the current loads; a missing warehouse raises AnalysisException."""
    return spark.read.parquet(f"{root}/{name}").join(current(spark, root), "load_id", "left_semi")
