"""Irregular readings onto a regular half-hourly grid (problem 6).

Each source is cut into time shards. A shard's first and last slot are its summary; a prefix scan
over the few summaries of a source carries the last slot before each shard into it; then all
shards are filled independently, so a source holding a third of all rows fills in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.timeline import HALF_HOUR_US, floor_div, from_micros, stamp

SHARD_SLOTS = 48 * 28


def slot_values(usable: DataFrame, step_us: int = HALF_HOUR_US) -> DataFrame:
    """(household_id, slot, kwh, readings): the usable readings of each half-open slot, summed exactly."""
    return usable.groupBy("household_id", floor_div(F.col("at_us"), step_us).alias("slot")).agg(
        F.sum("kwh").alias("kwh"), F.count("*").alias("readings")
    )


def with_carry(slots: DataFrame, shard_slots: int = SHARD_SLOTS, *carry: str) -> DataFrame:
    """Add ``before``: the source's previous occupied slot, null at its first, and ``before_`` and the name of
    each column in ``carry``: its value there.

    Inside a shard it is the neighbour in slot order. A shard's first and last row are its
    summary: the scan over them, at most two a shard, carries each shard's last slot to the head
    of the next. Both parts read one shuffle by (source, shard), and no join brings them together.
    """
    shard = Window.partitionBy("household_id", "_shard")
    inside, scan = shard.orderBy("slot"), Window.partitionBy("household_id").orderBy("slot")
    taken = {"before": "slot"} | {f"before_{c}": c for c in carry}
    cut = slots.withColumn("_shard", floor_div(F.col("slot"), shard_slots)).withColumns({n: F.lag(c).over(inside) for n, c in taken.items()} | {"_next": F.lead("slot").over(inside)})
    ends = cut.where(F.col("before").isNull() | F.col("_next").isNull())
    heads = ends.withColumns({f"_{n}": F.lag(c).over(scan) for n, c in taken.items()}).where(F.col("before").isNull()).withColumns({n: F.col(f"_{n}") for n in taken})
    rest = cut.where(F.col("before").isNotNull())
    return rest.drop("_shard", "_next").unionByName(heads.drop("_shard", "_next", *[f"_{n}" for n in taken]))


def gaps(slots: DataFrame, step_us: int = HALF_HOUR_US, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(household_id, gap_start, gap_end): each longest run of empty slots between two readings."""
    return (
        with_carry(slots.select("household_id", "slot"), shard_slots)
        .where(F.col("slot") - F.col("before") > 1)
        .select(
            "household_id",
            stamp(from_micros((F.col("before") + 1) * step_us)).alias("gap_start"),
            stamp(from_micros((F.col("slot") - 1) * step_us)).alias("gap_end"),
        )
    )


def regular_grid(slots: DataFrame, step_us: int = HALF_HOUR_US, shard_slots: int = SHARD_SLOTS, fill: str = "mark") -> DataFrame:
    """(household_id, slot_start, kwh, readings, is_missing): an unbroken series per source.

    Missing slots lie between a source's first and last reading; they are marked and carry null
    (``fill="mark"``), the last slot's value (``"carry"``) or a straight line between their
    neighbours (``"line"``). Filled values stay marked. A gap of any length is filled shard by shard, so
    one label in a far year costs no long array. An empty input gives no rows.
    """
    if fill not in ("mark", "carry", "line"):
        raise ValueError(f"unknown fill {fill!r}")
    carried = with_carry(slots, shard_slots, *(() if fill == "mark" else ("kwh",)))
    if fill == "mark":
        carried = carried.withColumn("before_kwh", F.lit(None).cast("decimal(38,10)"))
    first, last = F.col("before") + 1, F.col("slot") - 1
    shard_of = lambda c: floor_div(c, shard_slots)
    wide = F.coalesce(shard_of(last) > shard_of(first), F.lit(False))
    # A gap within a shard is filled with the slot after it; a longer one by each shard it reaches into.
    near = carried.withColumns({"from": F.when(wide, F.col("slot")).otherwise(F.coalesce(first, F.col("slot"))), "upto": F.col("slot")})
    far = carried.where(wide).withColumn("_shard", F.explode(F.sequence(shard_of(first), shard_of(last)))).repartition("household_id", "_shard")
    far = far.select(*carried.columns, F.greatest(first, F.col("_shard") * shard_slots).alias("from"), F.least(last, (F.col("_shard") + 1) * shard_slots - 1).alias("upto"))
    every = near.unionByName(far).withColumn("s", F.explode(F.sequence("from", "upto")))
    filled = {
        "mark": F.lit(None).cast("decimal(38,10)"),
        "carry": F.col("before_kwh"),
        "line": (F.col("before_kwh").cast("double") + (F.col("kwh") - F.col("before_kwh")).cast("double") * (F.col("s") - F.col("before")) / (F.col("slot") - F.col("before"))).cast("decimal(38,10)"),
    }[fill]
    own = F.col("s") == F.col("slot")
    return every.select(
        "household_id",
        from_micros(F.col("s") * step_us).alias("slot_start"),
        F.when(own, F.col("kwh")).otherwise(filled).cast("decimal(38,10)").alias("kwh"),
        F.when(own, F.col("readings")).otherwise(F.lit(0)).cast("bigint").alias("readings"),
        (~own).alias("is_missing"),
    )
