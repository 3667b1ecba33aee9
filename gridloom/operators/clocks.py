"""Which clock a load's labels without a zone were written on, and when it changed (problem 7).

For each load a history of clocks is chosen, out of fixed offsets and the zones given, that
violates least of what ingestion and sequence tell: no instant lies after the load's ingestion, no
household's labels step back, none stands in an hour its clock skips, and a step over such an hour
is no gap. The history of least cost is found by dynamic programming over stretches of the load's
sequence, each change of clock having its price. Among histories of equal cost the one wins whose
last instant lies as long before ingestion as labels of known zone do in other loads.

Rows only yield counts for stretches of ``BLOCK`` record numbers, in loads of any size. A load's
stretches are searched as they stream by in order; of those passed only the changes of clock that may
still be part of the best history are held, so a load may hold any number of rows.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from collections.abc import Iterator, Sequence
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.timeline import floor_div
from gridloom.shipping import ship

HOUR_US = 3_600_000_000
QUARTER_US = HOUR_US // 4
SLOT_US = HOUR_US // 2
BLOCK = 2_048
OUT_ROWS = 10_000
YEARS = (1970, 2069)
CLOCKS = ("Europe/London", "UTC", "Europe/Paris", "Europe/Athens", "Europe/Moscow", "America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "Asia/Kolkata", "Asia/Shanghai", "Asia/Tokyo", "Australia/Sydney")
# Cost of a change of clock: low for one no disorder of rows explains, else two agreeing steps are needed.
CHANGE, SMALL_CHANGE = 0.75, 1.5
LAG_SHARE, LAG_SPAN_US = 0.4, 12 * HOUR_US
HISTORY = "load_id string, from_no bigint, to_no bigint, clock string, violations double, support double"


def fixed_offsets() -> list[str]:
    """Every half hour from -12:00 to +14:00, written as Spark writes them."""
    return [f"{'-' if m < 0 else '+'}{abs(m) // 60:02d}:{abs(m) % 60:02d}" for m in range(-720, 841, 30)]


def offset_us(clock: str, wall_us: int) -> int:
    """The clock's offset from UTC at a wall time, in microseconds."""
    if clock[0] in "+-":
        return (1 if clock[0] == "+" else -1) * (int(clock[1:3]) * 60 + int(clock[4:])) * 60_000_000
    wall = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(wall_us))
    return int(wall.replace(tzinfo=zoneinfo.ZoneInfo(clock)).utcoffset().total_seconds()) * 1_000_000


def clock_changes(clocks: Sequence[str], years: tuple[int, int] = YEARS) -> list[tuple[str, int, int]]:
    """(clock, wall_us, shift_us) of each zone's changes: the wall time before it, positive for skipped hours."""
    out = []
    for name in clocks:
        if name[0] in "+-":
            continue
        zone = zoneinfo.ZoneInfo(name)
        at = dt.datetime(years[0], 1, 1, tzinfo=dt.UTC)
        before = at.astimezone(zone).utcoffset()
        while at.year <= years[1]:
            after = (at + dt.timedelta(days=1)).astimezone(zone).utcoffset()
            if after != before:
                lo, hi = 0, 86_400
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if (at + dt.timedelta(seconds=mid)).astimezone(zone).utcoffset() == before else (lo, mid)
                wall = (at + dt.timedelta(seconds=hi) + before).replace(tzinfo=None) - dt.datetime(1970, 1, 1)
                out.append((name, wall // dt.timedelta(microseconds=1), (after - before) // dt.timedelta(microseconds=1)))
                before = after
            at += dt.timedelta(days=1)
    return out


def _evidence(loose: DataFrame, changes: list[tuple[str, int, int]], block: int) -> DataFrame:
    """(load_id, block, kind, key, n, at_no) counts of (load_id, household_id, source_record_no, wall_us) rows.

    ``span``: rows and, as key, the latest label. ``back``: steps back, by quarter hours, those of
    an hour at most also as ``double`` by the hour they lie in. ``skip``: labels in an hour that some clock skips,
    by that hour. ``jump``: steps of more than an hour to the end of such an hour. at_no is the first record.
    """
    x = loose.withColumn("block", floor_div(F.col("source_record_no"), block))
    whole = Window.partitionBy("load_id", "household_id").orderBy("source_record_no")
    inside = Window.partitionBy("load_id", "household_id", "block").orderBy("source_record_no")
    x = x.withColumns({"before": F.lag("wall_us").over(inside), "after": F.lead("wall_us").over(inside)})
    # The first and last rows of a household in a block carry its label over to the next block.
    ends = x.where(F.col("before").isNull() | F.col("after").isNull()).withColumn("carried", F.lag("wall_us").over(whole))
    heads = ends.where(F.col("before").isNull()).withColumn("before", F.col("carried")).drop("carried")
    x = x.where(F.col("before").isNotNull()).unionByName(heads)
    step, hour = F.col("wall_us") - F.col("before"), floor_div(F.col("wall_us"), HOUR_US)
    skipped = sorted({w // HOUR_US for _, w, shift in changes if shift > 0})
    ended = sorted({(w + shift) // SLOT_US for _, w, shift in changes if shift > 0})
    # The literals number the zones given times the years, whatever the data.
    kind = lambda name, key: F.struct(F.lit(name).alias("kind"), key.cast("bigint").alias("key"))
    slot = floor_div(F.col("wall_us"), SLOT_US)
    kinds = F.array(
        F.when(hour.isin(skipped), kind("skip", hour)),
        F.when((step > HOUR_US) & (step <= 2 * HOUR_US) & slot.isin(ended), kind("jump", slot)),
        F.when(step < 0, kind("back", F.greatest(floor_div(step, QUARTER_US), F.lit(-200)))),
        F.when((step < 0) & (step >= -HOUR_US), kind("double", floor_div(F.col("before"), HOUR_US))),
    )
    found = x.select("load_id", "block", "source_record_no", F.inline(F.filter(kinds, lambda k: k.isNotNull())))
    found = found.groupBy("load_id", "block", "kind", "key").agg(F.count("*").alias("n"), F.min("source_record_no").alias("at_no"))
    span = x.groupBy("load_id", "block").agg(F.max("wall_us").alias("key"), F.count("*").alias("n"), F.min("source_record_no").alias("at_no"))
    return found.unionByName(span.withColumn("kind", F.lit("span")))


class _Search:
    """Finds the history of least cost of one load.

    A block's evidence is a list of (kind, key, n, at_no), as ``_evidence`` gives it.
    """

    def __init__(self, clocks: Sequence[str], changes: list[tuple[str, int, int]]):
        self.names = [*clocks, *fixed_offsets()]
        hours = lambda keep, key: {c: {key(w, s) for name, w, s in changes if name == c and keep(s)} for c in self.names}
        self.skipped = hours(lambda s: s > 0, lambda w, s: w // HOUR_US)
        self.ended = hours(lambda s: s > 0, lambda w, s: (w + s) // SLOT_US)
        self.doubled = hours(lambda s: s < 0, lambda w, s: (w + s) // HOUR_US)
        self.zones = [i for i, c in enumerate(self.names) if c[0] not in "+-"]
        self.fixed = np.array([0 if i in self.zones else offset_us(c, 0) for i, c in enumerate(self.names)])
        self.paired = None

    def offsets(self, wall_us: int) -> np.ndarray:
        """Each clock's offset at a wall time."""
        offset = self.fixed.copy()
        offset[self.zones] = [offset_us(self.names[i], wall_us) for i in self.zones]
        return offset

    def costs(self, e: list[tuple], offset: np.ndarray, loaded_us: float | None) -> np.ndarray:
        """Violations of a block under each clock."""
        cost = np.zeros(len(self.names))
        for kind, key, n, _ in e:
            if kind == "span":
                if loaded_us is not None:
                    cost += key - offset > loaded_us
            elif kind == "skip":
                cost += [n * (key in self.skipped[c]) for c in self.names]
            elif kind == "jump":
                cost += [n * (key not in self.ended[c]) for c in self.names]
            elif kind == "back":
                cost += n
            else:  # a step back of an hour at most is none where the clock runs that hour twice
                cost -= [n * (key in self.doubled[c]) for c in self.names]
        return cost

    def refunds(self, e: list[tuple], o: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """What a change from each clock to each other saves in a block, less the price of the change."""
        if self.paired is None or (self.paired[0] != o).any():
            # How far the labels fall back: the same few distances for many pairs of clocks.
            self.paired = o, *np.unique(o[:, None] - o[None, :], return_inverse=True)
        _, gap, pairs = self.paired
        price = np.where(gap > 2 * HOUR_US, CHANGE, SMALL_CHANGE)
        starts = {key: at_no for kind, key, _, at_no in e if kind == "back"}
        saved = np.zeros(len(gap))
        for kind, key, n, _ in e:
            if kind == "back":
                step = key * QUARTER_US + gap  # the true step, were this the change
                explained = (step >= -QUARTER_US) & (step <= HOUR_US)
                saved += np.where(explained, n - 1e-3 * np.abs(step - SLOT_US) / HOUR_US, -2.0 * n)
        refund = np.where(gap > 0, np.maximum(saved, 0), 0) - price
        return refund[pairs].reshape(len(o), len(o)), starts

    def history(self, load: str, blocks: Iterator[list[tuple]], loaded_us: float | None, lag_us: float | None) -> list[tuple]:
        """The load's rows of ``HISTORY`` from the evidence of its blocks in order.

        For each clock ``ways`` holds the best history that ends on it, as (first record, clock, history
        before). Histories share what they have in common, and one that no other goes on from is freed.
        """
        total, ways, last = None, [(None, c, None) for c in range(len(self.names))], None
        following = next(blocks)
        while following is not None:
            e, following = following, next(blocks, None)
            latest, first = next((key, at_no) for kind, key, _, at_no in e if kind == "span")
            last = latest if last is None else max(last, latest)
            offset = self.offsets(latest)
            cost = self.costs(e, offset, loaded_us)
            if total is None:
                cost += np.arange(len(self.names)) * 1e-6  # of equals, the clock named first
            if following is None and loaded_us is not None and lag_us is not None:
                cost += LAG_SHARE * np.minimum(1, np.abs(loaded_us - (last - offset) - lag_us) / LAG_SPAN_US)
            if total is None:
                total = cost
                continue
            refund, starts = self.refunds(e, offset)
            via = total[:, None] - refund
            via[np.diag_indices(len(total))] = total
            before = ways
            ways = []
            for c, came in enumerate(via.argmin(axis=0).tolist()):
                if came == c:
                    ways.append(before[c])
                else:
                    fall = int(offset[came] - offset[c])
                    hits = [starts[k] for k in range(-((QUARTER_US + fall) // QUARTER_US), (HOUR_US - fall) // QUARTER_US + 1) if k in starts]
                    ways.append((min(hits, default=first), c, before[came]))
            total = via.min(axis=0) + cost
        best = int(total.argmin())
        other = total[offset != offset[best]]
        support = float(other.min() - total[best]) if len(other) else 0.0
        out, to_no, way = [], None, ways[best]
        while way is not None:
            from_no, c, way = way
            out.append((load, from_no, to_no, self.names[c], float(total[best]), support))
            to_no = None if from_no is None else from_no - 1
        return out[::-1]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def clock_histories(labels: DataFrame, registry: DataFrame, clocks: Sequence[str] = CLOCKS, block: int = BLOCK) -> DataFrame:
    """(load_id, from_no, to_no, clock, violations, support): the clocks of each load's labels without a zone.

    ``labels`` are parsed labels (``instants.parsed_labels``). Null bounds are open; a load has a
    row more for each change of clock. support is how much dearer the best history is that ends
    on another offset: near 0, nothing in the load tells its offset. Loads without such labels give no row; loads the
    registry lacks are judged by sequence alone. A clock that starts to run ahead is noticed only by
    instants after ingestion or at its daylight-saving changes, since a step forward may be a gap.
    """
    ship(labels.sparkSession)
    changes = clock_changes(clocks)
    loose = labels.where(F.col("wall_us").isNotNull() & F.col("fixed_us").isNull() & F.col("text_region").isNull() & F.col("status_zone").isNull())
    found = _evidence(loose.select("load_id", "household_id", "source_record_no", "wall_us"), changes, block)
    loaded = registry.groupBy("load_id").agg(F.max(F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("loaded_at_utc"))).alias("loaded_us"))
    known = labels.where(F.col("wall_us").isNotNull() & (F.col("fixed_us").isNotNull()) | F.col("epoch_us").isNotNull()).groupBy("load_id").agg(F.max(F.coalesce(F.col("epoch_us"), F.col("wall_us") - F.col("fixed_us"))).alias("last_us"))
    lag = known.join(loaded, "load_id").select((F.col("loaded_us") - F.col("last_us")).alias("lag_us")).where((F.col("lag_us") >= 0) & (F.col("lag_us") < 48 * HOUR_US))
    usual = lag.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY lag_us)")).scalar()
    asked = found.join(loaded, "load_id", "left").select("load_id", F.col("loaded_us").cast("double"), usual.cast("double").alias("lag_us"), "block", "kind", "key", "n", "at_no")
    # As many parts as other shuffles have: few rows, but much to compute for each. By a hash of the key: a repartition
    # by the key of the join before it would be left out, and the join's parts may be cut where they are large.
    parts = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.repartition(parts, F.xxhash64("load_id")).sortWithinPartitions("load_id", "block", "kind", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(clocks, changes)
        schema = pa.schema([("load_id", pa.string()), ("from_no", pa.int64()), ("to_no", pa.int64()), ("clock", pa.string()), ("violations", pa.float64()), ("support", pa.float64())])
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple] = []
        for load, own in groupby(rows, itemgetter(0)):
            head = next(own)
            blocks = ([r[4:] for r in one] for _, one in groupby(chain([head], own), itemgetter(3)))
            out += search.history(load, blocks, head[1], head[2])
            while len(out) >= OUT_ROWS:
                yield _batch(out[:OUT_ROWS], schema)
                out = out[OUT_ROWS:]
        if out:
            yield _batch(out, schema)

    return asked.mapInArrow(run, HISTORY)


def covered(record_no: Column) -> Column:
    """Whether a history row holds for a record of its load."""
    return (F.col("from_no").isNull() | (record_no >= F.col("from_no"))) & (F.col("to_no").isNull() | (record_no <= F.col("to_no")))
