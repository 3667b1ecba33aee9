"""Row hashes and digests that identify content, and assertions that return violating rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of length-prefixed texts: nulls, empty texts and column boundaries all tell apart."""
    text = lambda c: F.col(c).cast("string")
    parts = [F.when(F.col(c).isNull(), F.lit("N;")).otherwise(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c), F.lit(";"))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def row_hashes(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(row_hash(columns).alias("row_hash"))


PIECES = 4


def _sums() -> list[Column]:
    """The sums of the four 64-bit pieces of the row hashes, exact for up to 10^18 rows."""
    piece = lambda i: F.conv(F.substring("row_hash", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
    return [F.coalesce(F.sum(piece(i)), F.lit(0)).cast("string") for i in range(PIECES)]


def multiset_digests(df: DataFrame, columns: list[str], *by: Column) -> DataFrame:
    """(by..., row_count, digest): the content of a table, or of each group, whatever the order of rows.

    Row hashes are added up piece by piece, so repeats count, sums meet map-side and a group of any
    size needs constant memory. The digest is the SHA-256 of the count and the sums. It tells
    changes of data apart; it does not stand up to someone who may choose rows to forge a sum.
    """
    hashed = df.select(*by, row_hash(columns).alias("row_hash"))
    one = F.sha2(F.concat_ws(",", F.count("*").cast("string"), *_sums()), 256)
    groups = [c for c in hashed.columns if c != "row_hash"]
    return (hashed.groupBy(*groups) if groups else hashed).agg(F.count("*").alias("row_count"), one.alias("digest"))


def bucket_digests(df: DataFrame, columns: list[str], prefix: int = 2) -> DataFrame:
    """(bucket, row_count, digest) per prefix of the row hash, to tell in which part of a table rows changed."""
    return multiset_digests(df, columns, F.substring(row_hash(columns), 1, prefix).alias("bucket"))


def content_digest(df: DataFrame, columns: list[str]) -> str:
    """One digest of a table, as text."""
    return multiset_digests(df, columns).first().digest


def evidence(df: DataFrame, name: str, without: tuple[str, ...] = ()) -> DataFrame:
    """(relation, schema, row_count, digest): what a table is, but for its provenance columns ``without``."""
    columns = [c for c in df.columns if c not in without]
    types = dict(df.dtypes)
    return multiset_digests(df, columns).select(F.lit(name).alias("relation"), F.lit(", ".join(f"{c} {types[c]}" for c in columns)).alias("schema"), "row_count", "digest")


def series_digests(days: DataFrame) -> DataFrame:
    """Per household: days, usable days, and the digests of its usable series and of its usable dates."""
    usable = days.where(F.col("unusable_reason").isNull())
    by = F.col("household_id")
    series = multiset_digests(usable, ["source_date", "kwh"], by).select("household_id", F.col("row_count").alias("usable_days"), F.col("digest").alias("series_digest"))
    dates = multiset_digests(usable, ["source_date"], by).select("household_id", F.col("digest").alias("dates_digest"))
    return series.join(dates, "household_id")


def grouped_totals(fact: DataFrame, by: str) -> DataFrame:
    """Exact totals of a group as text, for baselines compared field by field."""
    return fact.groupBy(F.col(by).alias("key")).agg(F.count("*").alias("row_count"), F.sum("consumption_kwh").cast("string").alias("kwh"), F.sum("energy_charge_gbp").cast("string").alias("amount"))


def described(fact: DataFrame) -> DataFrame:
    """One row: rows, households, date span and totals; the totals of no rows are 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("string")
    return fact.agg(F.count("*").alias("row_count"), F.count_distinct("household_id").alias("households"), F.min("source_date").alias("first_date"), F.max("source_date").alias("last_date"), total("consumption_kwh").alias("kwh"), total("energy_charge_gbp").alias("amount"))


def not_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).where("row_count > 1")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls) for each column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])).alias("x")).select("x.*")


def not_accepted(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.where(~F.col(column).isin(*values)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("row_count"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Distinct child keys without a parent; null keys are no orphans."""
    return child.where(F.col(child_key).isNotNull()).select(F.col(child_key).alias("key")).distinct().join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti")


def membership(whole: DataFrame, parts: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in one of two sets only, with the side; empty when the parts account for the whole."""
    a, b = whole.select(*columns), parts.select(*columns)
    return a.subtract(b).withColumn("side", F.lit("unaccounted")).unionByName(b.subtract(a).withColumn("side", F.lit("unexpected")))


def both_ways(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows one table holds more often than the other, one row for each surplus copy, with the side.

    Empty for tables equal as multisets, whatever the order of their rows; nulls equal nulls.
    """
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def shared_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys found in two tables that should have none in common; null keys are in neither."""
    mine, other = left.select(*keys).dropna().distinct(), right.select(*keys).dropna().distinct()
    return mine.join(other, keys, "left_semi")


def required_values(df: DataFrame, columns: list[str], required: list[tuple]) -> DataFrame:
    """(columns..., problem): required rows that are ``missing`` and rows that are ``unexpected``."""
    here = df.select(*columns).distinct()
    wanted = df.sparkSession.createDataFrame(required, df.select(*columns).schema).distinct()
    return wanted.subtract(here).withColumn("problem", F.lit("missing")).unionByName(here.subtract(wanted).withColumn("problem", F.lit("unexpected")))


def wrong_products(fact: DataFrame, prices: DataFrame) -> DataFrame:
    """Fact rows whose charge is not kWh times the price of their group and band, exactly, with what it should be."""
    p = prices.select("tariff_group", "band_label", F.col("price_gbp_per_kwh").alias("price"))
    should = (F.col("consumption_kwh") * F.col("price")).cast("decimal(38,16)")
    return fact.join(p, ["tariff_group", "band_label"]).where(~F.coalesce(F.col("energy_charge_gbp") == should, F.lit(True))).select("household_id", "source_timestamp_text", "band_label", "energy_charge_gbp", should.alias("expected_gbp")).distinct()
