"""Streams of raw records and of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.rejects import _number_reason, _timestamp_reason, record_fields
from gridloom.storage import read_bytes, write_bytes

RAW = "source_record_no bigint, raw_text string"


def raw_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files of raw records as they arrive in a folder."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def judged_stream(raw: DataFrame) -> DataFrame:
    """Each record with its fields and first reason to fail; stateless, so it runs in any output mode."""
    split = raw.select("source_record_no", F.inline(F.array(F.struct(record_fields(F.col("raw_text")).alias("fields")))))
    stamp, amount = F.get("fields", F.lit(2)), F.get("fields", F.lit(3))
    reason: Column = F.when(F.col("fields").isNull(), "broken_quoting").when(F.size("fields") != 4, "wrong_field_count").otherwise(F.coalesce(_timestamp_reason(stamp), _number_reason(amount)))
    return split.withColumn("reason", reason)


def to_tables(judged: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Write accepted and rejected records side by side; each micro-batch has its own folder, so a
    batch run again after a failure overwrites itself instead of doubling."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("reason is null").write.mode("overwrite").parquet(f"{root}/accepted/batch={number}")
        batch.where("reason is not null").write.mode("overwrite").parquet(f"{root}/rejected/batch={number}")
        batch.unpersist()

    return judged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_totals(readings: DataFrame, late: str = "2 hours", width: str = "1 day") -> DataFrame:
    """Totals per household and window of a stream of (household_id, instant, kwh).

    ``instant`` must be a timestamp whose zone is settled: naive labels bear no watermark. Repeats
    of a reading count once if they arrive within the watermark. This form keeps no row later than
    the watermark: where loads come late, use ``keep_all`` and ``kept_totals``.
    """
    return (
        readings.withWatermark("instant", late)
        .dropDuplicatesWithinWatermark(["household_id", "instant", "kwh"])
        .groupBy(F.window("instant", width).alias("w"), "household_id")
        .agg(F.sum("kwh").alias("kwh"), F.count("*").alias("readings"))
        .select("household_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kwh", "readings")
    )


def keep_all(readings: DataFrame, root: str, checkpoint: str, late: str = "2 hours") -> StreamingQuery:
    """Write a stream of (household_id, instant, kwh) so that no row is lost, late ones apart.

    A row more than ``late`` behind the newest instant of the batches before it goes to
    ``rows/late=true``, all others to ``rows/late=false``, both by day. Each batch has a folder of
    its own and notes the newest instant, so a batch run again after a failure overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = read_bytes(spark, f"{root}/frontier/{number - 1}") if number else None
        newest = int(before) if before else None
        behind = F.lit(False) if newest is None else F.col("instant") < F.timestamp_micros(F.lit(newest)) - F.expr(f"INTERVAL {late}")
        rows = batch.select("household_id", "instant", "kwh", F.coalesce(behind, F.lit(True)).alias("late"), F.to_date("instant").alias("day"), F.lit(number).alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "late", "day").parquet(f"{root}/rows")
        reached = batch.agg(F.max(F.unix_micros("instant"))).first()[0]
        write_bytes(spark, f"{root}/frontier/{number}", str(max(x for x in (reached, newest, 0) if x is not None)).encode())

    return readings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_totals(spark: SparkSession, root: str, include_late: bool = True) -> DataFrame:
    """(household_id, day, kwh, readings) of the rows kept so far; a repeated reading counts once."""
    rows = spark.read.parquet(f"{root}/rows")
    rows = rows if include_late else rows.where(~F.col("late"))
    return rows.select("household_id", "day", "instant", "kwh").distinct().groupBy("household_id", "day").agg(F.sum("kwh").alias("kwh"), F.count("*").alias("readings"))
