"""Runs of spike readings of every length the level-shift test leaves open."""

import datetime as dt
import math

from pyspark.sql import functions as F

from gridloom.operators import spikes
from gridloom.operators.usable import usable_readings
from tests.helpers import reading, readings

START = dt.datetime(2015, 1, 1)  # the start of a shard of 28 days, or 1344 half-hours


def label(k):
    return (START + dt.timedelta(minutes=30 * k)).isoformat(sep=" ")


def spiky(spark, planted, n=1344):
    """Spikes found in households of a smooth daily curve, at most 0.5, where ``planted`` gives other values by household and half-hour."""
    values = {(h, k): round(0.3 + 0.2 * math.sin(2 * math.pi * k / 48), 4) for h in planted for k in range(n)}
    values |= {(h, k): v for h, own in planted.items() for k, v in own.items()}
    data = [reading(i, h, label(k), v) for i, ((h, k), v) in enumerate(values.items())]
    found: dict[str, set] = {h: set() for h in planted}
    for r in spikes.implausible_report(usable_readings(readings(spark, data))).where(F.col("kind") == "spike").collect():
        found[r.household_id].add(int((dt.datetime.fromisoformat(r.observed_at) - START).total_seconds() // 1800))
    return found


def test_runs_of_up_to_five_spikes_are_found_and_longer_ones_are_ordinary(spark):
    planted = {f"HH000000{n}": {600 + j: 1.6 + j / 1000 for j in range(n)} | {900: 1.7} for n in range(1, 6)}
    assert spiky(spark, planted) == {h: set(own) for h, own in planted.items()}
    assert spiky(spark, {"HH0000006": {600 + j: 1.6 for j in range(6)}}) == {"HH0000006": set()}


def test_a_staircase_of_spikes_is_cleaned_from_its_top(spark):
    steps = {600 + j: v for j, v in enumerate((9.0, 5.5, 3.4, 2.1, 1.6))}
    assert spiky(spark, {"HH0000001": steps}) == {"HH0000001": set(steps)}


def test_shards_the_first_passes_leave_open_are_tested_again(spark):
    """Two passes leave the staircase open; testing its shard again, alone, gives what enough passes give."""
    data = [("a", k, round(0.3 + 0.2 * math.sin(2 * math.pi * k / 48), 4)) for k in range(600)] + [("a", 600 + j, v) for j, v in enumerate((9.0, 5.5, 3.4, 2.1, 1.6))] + [("a", k, 0.3) for k in range(605, 1300)]
    src = spikes._sharded(spark.createDataFrame(data, "household_id string, at_us bigint, kwh double").withColumn("kwh", F.col("kwh").cast("decimal(28,10)")), 10_000)
    base = spikes._with_halo(src, 10_000, 100)
    fits = spikes._fitted(base, 20)
    few, many = (spikes._tested(base, fits, 4.0, 5, n) for n in (2, 10))
    assert few.where("late").count() > 0 and many.where("late").count() == 0
    one = spikes._tested(spikes._with_halo(src, 10_000, 100, src.select("household_id", "shard").distinct()), fits, 4.0, 5, 10)
    assert one.where("outlying").count() == many.where("outlying").count() == 5


def test_a_block_counts_alike_wherever_a_shard_ends(spark):
    """Seven readings at one level are ordinary inside a shard and across its end; five are spikes in both places."""
    inside = {"HH0000001": {600 + j: 1.6 for j in range(7)}, "HH0000002": {600 + j: 1.6 + j / 1000 for j in range(5)}}
    across = {"HH0000003": {1341 + j: 1.6 for j in range(7)}, "HH0000004": {1341 + j: 1.6 + j / 1000 for j in range(5)}}
    found = spiky(spark, inside | across, n=2000)
    assert {h: len(v) for h, v in found.items()} == {"HH0000001": 0, "HH0000002": 5, "HH0000003": 0, "HH0000004": 5}
