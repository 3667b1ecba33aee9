"""Rolling totals, regular grids and implausible values against brute force on small data."""

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

from gridloom.operators import regular, rolling, spikes
from gridloom.operators.usable import usable_readings
from tests.helpers import reading, readings, rows

START = dt.datetime(2015, 1, 1)


def label(minutes):
    return (START + dt.timedelta(minutes=minutes)).isoformat(sep=" ")


def random_rows(seed, n=400, households=("HH0000001", "hh 000.0002", "0000003/HH")):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        m = rng.choice([30 * rng.randrange(48 * 90), rng.randrange(60 * 24 * 90)])
        out.append(reading(i, rng.choice(households), label(m), rng.choice([0, 0.5, 1.25, 2])))
    return out + out[:20]


def usable_set(data):
    return {("HH" + "".join(c for c in r[4] if c.isdigit()), r[7], r[11]) for r in data}


def test_usable_readings_normalises_and_counts_repeats_once(spark):
    data = [
        reading(1, "HH0000042", "2015-01-01 00:00:00", 1),
        reading(2, "hh-0000042", "2015-01-01 00:00:00", "1.0"),
        reading(3, " 0000042/HH", "2015-01-01 00:00:00", 2),
        reading(4, "HH0000042", "2015-01-01 00:00:00", 3, status="utc"),
        reading(5, "HH0000042", None, 3),
        reading(6, "HH0000042", "2015-01-01 00:00:00", None),
        reading(7, None, "2015-01-01 00:00:00", 3),
        reading(8, "--", "2015-01-01 00:00:00", 3),
    ]
    got = rows(usable_readings(readings(spark, data)).select("household_id", "kwh"))
    assert got == [("HH0000042", Decimal("1.0000000000")), ("HH0000042", Decimal("2.0000000000"))]


def test_rolling_totals_match_brute_force(spark):
    data = random_rows(1)
    daily = defaultdict(lambda: [Decimal(0), 0])
    for h, t, v in usable_set(data):
        daily[h, t.date()][0] += v
        daily[h, t.date()][1] += 1
    expect = set()
    for h in {h for h, _ in daily}:
        days = sorted(d for x, d in daily if x == h)
        day = days[0]
        while day <= days[-1]:
            for w in (7, 30):
                parts = [daily[h, day - dt.timedelta(k)] for k in range(w) if (h, day - dt.timedelta(k)) in daily]
                expect.add((h, day, w, sum((p[0] for p in parts), Decimal(0)), sum(p[1] for p in parts)))
            day += dt.timedelta(1)
    df = rolling.rolling_totals(rolling.daily_amounts(usable_readings(readings(spark, data))))
    got = {(r.household_id, r.day, r.window_days, r.total_kwh, r.readings) for r in df.collect()}
    assert got == expect
    silent = rolling.silent_windows(rolling.daily_amounts(usable_readings(readings(spark, data))))
    assert {tuple(r) for r in silent.collect()} == {(h, d.isoformat(), w) for h, d, w, _, n in expect if n == 0}


def test_gaps_and_grid_match_brute_force_across_shards(spark):
    data = random_rows(2, n=120)
    slots = defaultdict(set)
    for h, t, _ in usable_set(data):
        slots[h].add(int((t - dt.datetime(1970, 1, 1)).total_seconds() // 1800))
    expect = set()
    text = lambda s: (dt.datetime(1970, 1, 1) + dt.timedelta(minutes=30 * s)).isoformat(sep=" ")
    for h, own in slots.items():
        line = sorted(own)
        expect |= {(h, text(a + 1), text(b - 1)) for a, b in zip(line, line[1:]) if b - a > 1}
    values = regular.slot_values(usable_readings(readings(spark, data)))
    for shard in (1, 48, 48 * 28):
        assert {tuple(r) for r in regular.gaps(values, shard_slots=shard).collect()} == expect
    grid = regular.regular_grid(values)
    assert grid.count() == sum(max(s) - min(s) + 1 for s in slots.values())
    assert grid.where("is_missing").count() == sum(max(s) - min(s) + 1 - len(s) for s in slots.values())
    assert grid.where("is_missing and kwh is not null").count() == 0


def test_grid_fills(spark):
    data = [reading(1, "HH0000001", "2015-01-01 00:00:00", 1), reading(2, "HH0000001", "2015-01-01 01:30:00", 4)]
    values = regular.slot_values(usable_readings(readings(spark, data)))
    carry = [float(r.kwh) for r in regular.regular_grid(values, fill="carry").orderBy("slot_start").collect()]
    line = [float(r.kwh) for r in regular.regular_grid(values, fill="line").orderBy("slot_start").collect()]
    assert carry == [1, 1, 1, 4] and line == [1, 2, 3, 4]


def test_spikes_stuck_and_impossible(spark):
    rng = random.Random(5)
    data, no = [], 0
    values = {}

    def add(h, k, v):
        nonlocal no
        no += 1
        values[h, k] = v
        data.append(reading(no, h, label(30 * k), v))

    for k in range(3000):  # more than two shards of 28 days
        add("HH0000001", k, round(rng.uniform(0.05, 0.5), 4))
    for k, v in ((100, 7.5), (2000, 9.0), (2001, 8.0), (1344, 6.0)):
        values["HH0000001", k] = v
    values["HH0000001", 50], values["HH0000001", 60] = -0.1, 11.6
    for k in range(1330, 1360):  # a stuck run over the shard boundary
        if k != 1344:
            values["HH0000001", k] = 0.2222
    for k in range(400, 425):
        values["HH0000001", k] = 0.0
    for k in range(700, 760):  # a level shift is ordinary
        values["HH0000001", k] = round(rng.uniform(1.7, 1.9), 4)
    for k in range(10):
        add("HH0000002", k, 100)
    data = [reading(i, h, label(30 * k), v) for i, ((h, k), v) in enumerate(values.items())]
    got = {(r.household_id, r.observed_at, r.kind) for r in spikes.implausible_report(usable_readings(readings(spark, data))).collect()}
    expect = {("HH0000001", label(30 * k), "spike") for k in (100, 2000, 2001, 1344)} | {("HH0000001", label(30 * k), "impossible") for k in (50, 60)}
    assert got == expect  # 14 and 15 equal values in a row are no run of 20
    values["HH0000001", 1344] = 0.2222
    data = [reading(i, h, label(30 * k), v) for i, ((h, k), v) in enumerate(values.items())]
    got = {(r.household_id, r.observed_at, r.kind) for r in spikes.implausible_report(usable_readings(readings(spark, data))).collect()}
    expect -= {("HH0000001", label(30 * 1344), "spike")}
    assert got == expect | {("HH0000001", label(30 * k), "stuck") for k in range(1330, 1360)}


def test_empty_tables_give_no_rows(spark):
    u = usable_readings(readings(spark, []))
    assert rolling.rolling_totals(rolling.daily_amounts(u)).count() == 0
    assert rolling.silent_windows(rolling.daily_amounts(u)).count() == 0
    assert regular.gaps(regular.slot_values(u)).count() == 0
    assert regular.regular_grid(regular.slot_values(u)).count() == 0
    assert spikes.implausible_report(u).count() == 0


def test_extra_columns_with_clashing_names(spark):
    df = readings(spark, random_rows(3, n=60))
    for c in ("shard", "slot", "kwh", "at_us", "day", "z", "run", "before", "kind"):
        df = df.withColumn(c, df["member_name"])
    u = usable_readings(df)
    assert regular.gaps(regular.slot_values(u)).count() > 0
    assert rolling.rolling_totals(rolling.daily_amounts(u)).count() > 0
    spikes.implausible_report(u).collect()
