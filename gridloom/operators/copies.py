"""Differences between two copies of one dataset by content-defined chunking (problem 1).

Both sides are hashed row by row and range-partitioned together by key, so equal keys meet in one
partition without a join. There each side's key-sorted rows are cut where a rolling hash over the
last rows meets a condition; a cut depends on the rows around it alone, so both sides cut alike
again a few rows after any difference. Chunks whose fingerprint the other side has too are equal
and leave: as both sides of a key range lie in one partition, in key order, this anti-join runs
along the stream, chunk by chunk, in bounded memory. Only rows of unmatched chunks are read again
and compared field by field.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType, StructField, StructType

from gridloom.shipping import ship
from gridloom.storage import materialize

ROLL = 4
REGION_ROWS = 200_000


def _marked(columns: Sequence[str]) -> list[Column]:
    """Fields to hash with their nulls marked, since the hash functions skip nulls."""
    return [x for c in columns for x in (F.col(c).isNull(), F.col(c))]


class _Chunker:
    """Cuts merged, sorted rows of two sides into chunks and keeps those of unmatched chunks."""

    # Odd multipliers that mix the hashes of a window by place.
    WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)

    def __init__(self, mask: int, region_rows: int):
        self.mask, self.region_rows = np.uint64(mask), region_rows
        self.tail = [np.zeros(ROLL - 1, np.uint64), np.zeros(ROLL - 1, np.uint64)]

    def side_chunks(self, at: np.ndarray, h1: np.ndarray, h2: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, first row of each chunk among them, fingerprints) of one side of a region.

        Identical repeats are neighbours and count once; a region's first row opens a chunk.
        """
        new = np.ones(len(at), bool)
        new[1:] = (h1[at[1:]] != h1[at[:-1]]) | (h2[at[1:]] != h2[at[:-1]])
        at = at[new]
        line = np.concatenate([self.tail[s], h1[at].view(np.uint64)])
        rolled = np.zeros(len(at), np.uint64)
        for j in range(ROLL):
            rolled += line[j : j + len(at)] * self.WEIGHTS[j]
        rolled ^= rolled >> np.uint64(29)
        cuts = (rolled & self.mask) == 0
        cuts[:1] = True
        first = np.flatnonzero(cuts)
        prints = np.zeros(len(first), [("x1", np.int64), ("x2", np.int64), ("n", np.int64)])
        if len(first):
            prints["x1"] = np.bitwise_xor.reduceat(h1[at], first)
            prints["x2"] = np.bitwise_xor.reduceat(h2[at].astype(np.int64), first)
            prints["n"] = np.diff(np.append(first, len(at)))
        return at, first, prints

    def unmatched(self, side: np.ndarray, h1: np.ndarray, h2: np.ndarray, final: bool) -> tuple[np.ndarray, int]:
        """Rows of unmatched chunks of a region, and how many of its first rows are done with.

        Rows are done up to a place that no chunk of either side spans. A region that has grown
        to its limit ends as it is, for both sides at the same key.
        """
        parts = [self.side_chunks(np.flatnonzero(side == s), h1, h2, s) for s in (0, 1)]
        done = len(side)
        if not final:
            for at, first, _ in parts:
                if len(at):
                    done = min(done, int(at[first[-1]]))  # the last chunk may go on
            moved = True
            while moved and done:
                moved = False
                for at, first, _ in parts:
                    k = int(np.searchsorted(at[first], done, "left")) - 1  # the last chunk begun before
                    if k >= 0:
                        end = first[k + 1] if k + 1 < len(first) else len(at)
                        if at[end - 1] >= done:
                            done, moved = int(at[first[k]]), True
            if not done and len(side) >= self.region_rows:
                done = len(side)
        out = []
        for s, (at, first, prints) in enumerate(parts):
            inside = at[first] < done if len(at) else np.zeros(0, bool)
            lone = inside & ~np.isin(prints, parts[1 - s][2])
            size = prints["n"]
            out.append(at[np.repeat(lone, size)] if len(at) else at)
            past = at[at < done]
            self.tail[s] = np.concatenate([self.tail[s], h1[past].view(np.uint64)])[-(ROLL - 1) :]
        return np.sort(np.concatenate(out)), done


def _unmatched_rows(mask: int, region_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = _Chunker(mask, region_rows)
        held: pa.Table | None = None

        def step(rows: pa.Table, final: bool) -> tuple[pa.Table, pa.Table]:
            numbers = [rows.column(c).to_numpy() for c in ("side", "h1", "h2")]
            lone, done = chunker.unmatched(*numbers, final)
            return rows.take(pa.array(lone)), rows.slice(done)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None or not held.num_rows else pa.concat_tables([held, rows])
            found, held = step(rows, final=False)
            yield from found.combine_chunks().to_batches()
        if held is not None and held.num_rows:
            yield from step(held, final=True)[0].combine_chunks().to_batches()

    return run


def suspicious_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], chunk_rows: int = 16, region_rows: int = REGION_ROWS) -> DataFrame:
    """Keys of rows that lie in an unmatched chunk and have no identical row in one of the other side."""
    ship(left.sparkSession)
    names = [f"_k{i}" for i in range(len(keys))]

    def hashed(df: DataFrame, side: int) -> DataFrame:
        fields = _marked(columns)
        return df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.lit(side).cast("tinyint").alias("side"), F.xxhash64(*fields).alias("h1"), F.hash(*fields).alias("h2"))

    both = hashed(left, 0).unionByName(hashed(right, 1))
    spread = both.repartitionByRange(*[F.col(n) for n in names], "h1").sortWithinPartitions(*names, "h1", "h2", "side")
    kinds = ", ".join(f"{n} {both.schema[n].dataType.simpleString()}" for n in names)
    mask = (1 << max(1, (chunk_rows - 1).bit_length())) - 1
    rows = spread.mapInArrow(_unmatched_rows(mask, region_rows), f"{kinds}, side tinyint, h1 bigint, h2 int")
    alone = rows.groupBy(*names, "h1", "h2").agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a = b")
    return materialize(alone.select(*names).distinct(), "suspects")


def schema_differences(left: DataFrame, right: DataFrame) -> list[tuple[str, str, str | None, str | None]]:
    """(column, kind, left type, right type) of columns only one side has, or whose types differ."""
    l, r = dict(left.dtypes), dict(right.dtypes)
    kind = lambda c: "missing_in_right" if c not in r else "missing_in_left" if c not in l else "type_differs"
    return [(c, kind(c), l.get(c), r.get(c)) for c in [*l, *(c for c in r if c not in l)] if l.get(c) != r.get(c)]


def aligned(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides cut to the columns they share, in types that compare, and those columns.

    Decimals go to the scale and digits that hold both sides exactly where 38 digits do; other
    types that differ are compared as text.
    """
    right_types = {f.name: f.dataType for f in right.schema}
    casts: dict[str, str] = {}
    for f in left.schema:
        other = right_types.get(f.name)
        if other is None or other == f.dataType:
            continue
        both = (f.dataType, other)
        if all(isinstance(t, DecimalType) for t in both):
            scale, whole = max(t.scale for t in both), max(t.precision - t.scale for t in both)
            casts[f.name] = f"decimal({scale + whole},{scale})" if scale + whole <= 38 else "string"
        elif all(isinstance(t, IntegralType) for t in both):
            casts[f.name] = "bigint"
        else:
            casts[f.name] = "string"
    columns = [f.name for f in left.schema if f.name in right_types]
    cut = lambda df: df.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in columns])
    return cut(left), cut(right), columns


def diff_copies(left: DataFrame, right: DataFrame, keys: Sequence[str], chunk_rows: int = 16, region_rows: int = REGION_ROWS) -> DataFrame:
    """(keys..., difference, left_value, right_value, left_values, right_values): what two copies of a dataset disagree in.

    difference is ``missing_in_right``, ``missing_in_left`` or a differing column's name. For a
    column, left_value is the smallest value, as text, that only that side has at the key (null
    for a null, and where it has none), and left_values counts such values; likewise right. Keys
    and values compare exactly as stored and null equals null, also in keys; decimals of another
    scale compare by value; identical repeats on a side are one row. Where a key has several rows
    on a side, a field differs if one side has a value of it the other lacks; if all fields agree
    so but the rows do not, each field with more than one value is reported. A column that only
    one side has gives one row with null keys, the difference ``column_missing_in_right: name`` (or
    left), and is compared no further. Two empty inputs of one schema give no rows.
    """
    lone = [(c, kind) for c, kind, _, _ in schema_differences(left, right) if kind != "type_differs"]
    left, right, columns = aligned(left, right)
    names = [f"_k{i}" for i in range(len(keys))]
    suspects = suspicious_keys(left, right, keys, columns, chunk_rows, region_rows)
    fields = [c for c in columns if c not in keys]

    def full(df: DataFrame, side: int) -> DataFrame:
        here = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[F.col(c).cast("string").alias(f"_v{i}") for i, c in enumerate(fields)])
        same = reduce(lambda a, b: a & b, [here[n].eqNullSafe(suspects[n]) for n in names])
        return here.join(suspects, same, "left_semi").distinct().withColumn("side", F.lit(side))

    rows = full(left, 0).unionByName(full(right, 1))
    by_key = rows.groupBy(*names).agg(F.min("side").alias("a"), F.max("side").alias("b"))
    nothing = [F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value"), F.lit(0).cast("bigint").alias("left_values"), F.lit(0).cast("bigint").alias("right_values")]
    found = by_key.where("a = b").select(*names, F.when(F.col("a") == 0, "missing_in_right").otherwise("missing_in_left").alias("difference"), *nothing)
    if fields:
        cells = rows.select(*names, "side", F.posexplode(F.array(*[F.struct(F.col(f"_v{i}").alias("value")) for i in range(len(fields))])).alias("field", "cell"))
        cells = cells.groupBy(*names, "field", "cell").agg(F.min("side").alias("a"), F.max("side").alias("b"))
        only = lambda s: (F.col("a") == s) & (F.col("b") == s)
        per_field = cells.groupBy(*names, "field").agg(
            F.count("*").alias("values"),
            F.count_if(F.col("a") == F.col("b")).alias("one_sided"),
            F.min("a").alias("first"),
            F.max("b").alias("last"),
            F.min(F.when(only(0), F.col("cell.value"))).alias("left_value"),
            F.min(F.when(only(1), F.col("cell.value"))).alias("right_value"),
            F.count_if(only(0)).alias("left_values"),
            F.count_if(only(1)).alias("right_values"),
        )
        both = per_field.where("first != last")
        clear = both.groupBy(*names).agg(F.max("one_sided").alias("most"))
        same = reduce(lambda a, b: a & b, [both[n].eqNullSafe(clear[n]) for n in names])
        differing = both.join(clear.where("most = 0"), same, "left_semi").where("values > 1").unionByName(both.where("one_sided > 0"))
        label = F.element_at(F.array(*[F.lit(c) for c in fields]), F.col("field") + 1)
        found = differing.select(*names, label.alias("difference"), "left_value", "right_value", "left_values", "right_values").unionByName(found)
    if lone:
        text = [(*[None] * len(keys), f"column_{kind}: {c}", None, None, 0, 0) for c, kind in lone]
        found = found.unionByName(left.sparkSession.createDataFrame(text, StructType([StructField(f.name, f.dataType) for f in found.schema])))
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "difference", "left_value", "right_value", "left_values", "right_values")
