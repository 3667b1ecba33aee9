"""Hand-computed cases of the reference's operators."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from gridloom.operators import analytics, daily, digests, expansion, explore, forecast, policy, profile, terrain
from tests.helpers import reading, readings, rows

DAY = dt.date(2013, 1, 1)


def golden(spark):
    """16 rows that collapse to 14 distinct readings; two labels are in conflict."""
    d = "2013-01-01 "
    spec = [("00:00:00", 0), ("00:30:00", 2), ("00:30:00", 2), ("01:00:00", "4.0"), ("01:00:00", 4), ("02:00:00", 1.5), ("01:30:00", 1), ("03:00:00", 0.3), ("03:00:00", 0.9), ("04:00:00", 0.4), ("04:00:00", None), ("05:00:00", None), ("06:37:27", 0.5)]
    data = [reading(i, "MAC1", d + t, v) for i, (t, v) in enumerate(spec, 1)]
    data += [reading(14, "MAC1", "2014-01-01 00:00:00", 1), reading(15, "MAC1", "2012-12-31 23:00:00", 1), reading(16, "MAC2", d + "02:00:00", 7, group="Std")]
    return readings(spark, data)


def test_distinct_and_conflicts(spark):
    r = golden(spark)
    assert policy.distinct_readings(r).count() == 14
    assert policy.distinct_raw_readings(r).count() == 15  # 4.0 and 4 are two texts of one value
    assert {x.source_timestamp_text[11:16] for x in policy.conflicting_labels(r).collect()} == {"03:00", "04:00"}
    kinds = {x.source_timestamp_text[11:16]: x.kind for x in policy.label_agreement(r).collect()}
    assert kinds == {"00:30": "exact_duplicate", "01:00": "equivalent_representation", "03:00": "conflict", "04:00": "conflict"}
    q = policy.quality_summary(r).where("household_id = 'MAC1'").collect()[0]
    assert (q.observed_records, q.distinct_readings, q.exact_duplicate_extras, q.conflicting_labels, q.off_grid_rows) == (15, 13, 1, 2, 1)


def test_banded_readings_join_labels_and_half_open_validity(spark):
    schedule = spark.createDataFrame([(dt.datetime(2013, 1, 1, 0, 0), "Normal"), (dt.datetime(2013, 1, 1, 0, 30), "Low"), (dt.datetime(2013, 1, 1, 1, 0), "High"), (dt.datetime(2013, 1, 1, 2, 0), "Normal"), (dt.datetime(2014, 1, 1), "Normal")], "schedule_label_naive timestamp_ntz, band_label string")
    price = lambda b, p: ("ToU", b, Decimal(p) * 100, Decimal(p), dt.date(2013, 1, 1), dt.date(2014, 1, 1))
    prices = spark.createDataFrame(
        [price("High", "0.672"), price("Normal", "0.1176"), price("Low", "0.0399"), ("Std", "flat", Decimal("14.228"), Decimal("0.14228"), None, None)],
        "tariff_group string, band_label string, price_pence_per_kwh decimal(9,4), price_gbp_per_kwh decimal(9,6), effective_from date, effective_until date",
    )
    got = analytics.banded_readings(golden(spark), schedule, prices)
    assert got.count() == 14
    amounts = {r.source_timestamp_text[:16]: r.amount_gbp for r in got.where("amount_gbp is not null").collect()}
    assert amounts == {"2013-01-01 00:00": 0, "2013-01-01 00:30": Decimal("0.0798"), "2013-01-01 01:00": Decimal("2.688"), "2013-01-01 02:00": Decimal("0.1764")}
    edge = got.where("source_timestamp_text like '2014%'").collect()[0]
    assert edge.band_label == "Normal" and edge.price_gbp_per_kwh is None and not edge.outside_schedule
    assert got.where("outside_schedule").count() == 1


def days_frame(spark, data):
    """(household, day offset, kwh or None for an unusable day)."""
    made = [(h, DAY + dt.timedelta(o), None if v is None else Decimal(str(v)), 48 if v is not None else 3, 0, 0, False) for h, o, v in data]
    df = spark.createDataFrame(made, "household_id string, source_date date, kwh decimal(38,10), grid_intervals int, non_numeric_rows int, off_grid_rows int, has_conflict boolean")
    return daily.with_usability(df)


def test_longest_run_takes_the_earliest_of_equals(spark):
    d = days_frame(spark, [("a", o, 1) for o in (0, 1, 5, 6, 9)] + [("b", 3, 1)])
    got = {r.household_id: (r.start, r.days) for r in daily.longest_runs(d).collect()}
    assert got == {"a": (DAY, 2), "b": (DAY + dt.timedelta(3), 1)}


def test_zero_runs_and_their_neighbours(spark):
    d = days_frame(spark, [("a", 0, 1), ("a", 1, 0), ("a", 2, 0), ("a", 3, 2), ("a", 4, 0), ("a", 6, 0), ("a", 7, None), ("b", 0, 0)])
    got = {(r.household_id, (r.start - DAY).days, r.days): (r.before, r.after, r.bounded, r.bucket) for r in daily.zero_runs(d).collect()}
    assert got == {
        ("a", 1, 2): ("nonzero_usable", "nonzero_usable", True, "2-6"),
        ("a", 4, 1): ("nonzero_usable", "absent", False, "1"),
        ("a", 6, 1): ("absent", "unusable:incomplete", False, "1"),
        ("b", 0, 1): ("recorded_span_edge", "recorded_span_edge", False, "1"),
    }


def test_daily_totals_withhold_conflicts_and_never_fill_days(spark):
    data = [reading(1, "H", "2013-01-01 00:00:00", 1), reading(2, "H", "2013-01-01 00:00:00", 1), reading(3, "H", "2013-01-01 00:15:00", 9), reading(4, "H", "2013-01-03 00:00:00", 1), reading(5, "H", "2013-01-03 00:00:00", 2), reading(6, "H", "2013-01-04 00:00:00", None)]
    got = {r.source_date.day: (r.total_status, r.recorded_kwh, r.has_rows, r.duplicates_removed, r.off_grid_rows) for r in explore.daily_totals(readings(spark, data)).collect()}
    assert got == {1: ("published", Decimal("1.0000000000"), True, 1, 1), 2: ("none", None, False, 0, 0), 3: ("withheld", None, True, 0, 0), 4: ("none", None, True, 0, 0)}


def test_nearest_rank_and_distribution(spark):
    values = [0.5, 0.1, 0.9, 0.3, 1.0, 0.2, 0.8, 0.4, 0.7, 0.6, None]
    r = readings(spark, [reading(i, "H", "2013-01-01 00:00:00", v) for i, v in enumerate(values)])
    got = {x.percent: float(x.value) for x in profile.nearest_rank_percentiles(r, (25, 50, 75)).collect()}
    assert got == {25: 0.3, 50: 0.5, 75: 0.8}
    d = profile.distribution(r).collect()[0]
    assert (float(d.total), float(d.mean), d.finite_values) == (5.5, 0.55, 10)


def test_value_categories(spark):
    cases = {" 0.143 ": "finite_numeric", "Null": "null_token", " Null ": "null_token", "NULL": "unexpected_token", "": "empty", " \t": "empty", " nan ": "non_finite_numeric", " Infinity ": "non_finite_numeric", " -1.5 ": "finite_numeric", "1e3": "finite_numeric", ".5": "finite_numeric", "5.": "finite_numeric", ".": "unexpected_token", "0,5": "unexpected_token", " 0.1\xa0": "finite_numeric", None: None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string")
    assert [(r.raw, r.got) for r in df.withColumn("got", profile.value_category(F.col("raw"))).collect() if r.got != r.want] == []


def test_expansion_balances(spark):
    base = [reading(1, "A", "2013-01-01 00:00:00", 1, member="m1"), reading(2, "A", "2013-01-01 00:30:00", 2, member="m1")]
    extra = [reading(3, "A", "2013-01-01 01:00:00", 4, member="m2"), reading(4, "A", "2013-01-01 00:00:00", 1, member="m2"), reading(5, "A", "2013-01-01 00:30:00", 3, member="m2"), reading(6, "B", "2013-01-01 00:00:00", 8, member="m2")]
    b, w = readings(spark, base), readings(spark, base + extra)
    got = {r.household_id: tuple(map(float, (r.base_kwh, r.added_kwh, r.removed_kwh, r.changed_kwh, r.wider_kwh, r.residual))) for r in expansion.reconciliation(b, w).collect()}
    assert got == {"A": (3, 4, 2, 0, 5, 0), "B": (0, 8, 0, 0, 8, 0)}
    assert expansion.new_conflicts(b, w).count() == 1
    assert rows(expansion.supplied_by(b, w)) == [("A", "m2", 1), ("B", "m2", 1)]
    assert rows(expansion.repeated_readings(b, w)) == [("m2", 1)]


def series(spark, change=None, n=40):
    data = [("a", o, o % 7 + 1) for o in range(n) if o != 20] + [("a", 20, 5)]
    return days_frame(spark, [(h, o, 99 if change and o >= change else v) for h, o, v in data])


SHORT = forecast.Schedule(horizon=7, warmup=14, holdout=7, step=7, min_run=30, weeks=2)


def test_weekly_series_is_forecast_exactly(spark):
    c = forecast.backtest(series(spark), SHORT)
    assert c.where("model = 'seasonal_naive' and excluded_reason is null and abs_error > 0 and target_date <> date'2013-01-28'").where(F.col("target_date") != DAY + dt.timedelta(20)).count() == 0
    assert {r.split for r in c.select("split").distinct().collect()} == {"development", "holdout"}
    assert forecast.common_frame(forecast.wide_cases(series(spark), SHORT)).count() % 3 == 0


def test_the_future_never_moves_a_prediction(spark):
    late = DAY + dt.timedelta(25)
    pick = lambda d: rows(forecast.backtest(d, SHORT).where(F.col("origin") < late).select("origin", "horizon", "model", "predicted"))
    assert pick(series(spark)) == pick(series(spark, change=25))


def test_weekday_mean_takes_the_latest_usable_days_not_fixed_lags(spark):
    d = days_frame(spark, [("a", o, o) for o in range(0, 40) if o not in (14, 21)])
    s = forecast.Schedule(horizon=1, step=1, weeks=2, window=28, min_usable=20)
    got = {r.origin: r for r in forecast.prior_cases(d, s).collect()}
    assert got[DAY + dt.timedelta(27)].weekday_mean == (7 + 0) / 2 and got[DAY + dt.timedelta(27)].last_day == 27
    assert got[DAY + dt.timedelta(28)].weekday_mean == (22 + 15) / 2 and got[DAY + dt.timedelta(28)].target_state == "scoreable"


def test_terrain_tells_zero_from_empty(spark):
    schedule = spark.createDataFrame([(dt.datetime(2013, 1, 1) + dt.timedelta(minutes=30 * i), "Low") for i in range(48)], "schedule_label_naive timestamp_ntz, band_label string")
    fact = spark.createDataFrame([("h", dt.datetime(2013, 1, 1), DAY, "Low", Decimal(0), Decimal(0)), ("g", dt.datetime(2013, 1, 1, 0, 30), DAY, "Low", Decimal(2), Decimal(3)), ("h", dt.datetime(2013, 1, 1, 0, 30), DAY, "Low", Decimal(1), Decimal(1))], "household_id string, observed_at_naive timestamp_ntz, source_date date, band_label string, consumption_kwh decimal(28,10), energy_charge_gbp decimal(38,16)")
    cells = terrain.dense_cells(fact, schedule)
    got = {r.cell: (r.row_count, r.households, r.kwh) for r in cells.collect()}
    assert len(got) == 48 and got[0] == (1, 1, 0) and got[1] == (2, 2, 3) and got[2] == (0, 0, None)
    assert [(r.measure, r.cell) for r in terrain.peaks(cells).orderBy("measure").collect()] == [("amount_gbp", 1), ("kwh", 1)]
    assert [len(r.kwh_by_slot) for r in terrain.day_rows(cells).collect()] == [48]


def test_digests(spark):
    cols = ["a", "b"]
    make = lambda d: spark.createDataFrame(d, "a string, b string")
    base = [("x", None), ("y", "z"), ("y", "z")]
    digest = lambda d: digests.content_digest(make(d), cols)
    assert digest(base) == digest(base[::-1])
    others = [base[:2], [("x", ""), *base[1:]], [("x", "N"), *base[1:]], [("xy", None), ("", "z"), ("y", "z")], [("yz", ""), *base[1:]], []]
    assert len({digest(d) for d in [base, *others]}) == 7
    buckets = lambda d: {r.bucket: (r.row_count, r.digest) for r in digests.bucket_digests(make(d), cols).collect()}
    one, other = buckets(base), buckets([("x", "w"), *base[1:]])
    assert sum(n for n, _ in one.values()) == 3 and {k for k in one if one[k] == other.get(k)} and one != other
    plan = digests.bucket_digests(make(base), cols)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect" not in plan


def test_multisets_both_ways_and_required_rows(spark):
    make = lambda d: spark.createDataFrame(d, "a string, b string")
    left, right = make([("x", None), ("x", None), ("y", "z")]), make([("x", None), ("w", "z")])
    assert rows(digests.both_ways(left, right, ["a", "b"])) == [("w", "z", "right"), ("x", None, "left"), ("y", "z", "left")]
    assert rows(digests.shared_keys(left, right, ["a"])) == [("x",)] and digests.shared_keys(left, make([]), ["a"]).count() == 0
    assert rows(digests.required_values(left, ["a", "b"], [("y", "z"), ("q", "q")])) == [("q", "q", "missing"), ("x", None, "unexpected")]


def test_step_order_carries_over_blocks(spark):
    rng = random.Random(1)
    minutes = [rng.randrange(200) for _ in range(300)]
    data = [reading(i, "H", (dt.datetime(2013, 1, 1) + dt.timedelta(minutes=m)).isoformat(sep=" "), 1) for i, m in enumerate(minutes)]
    want = (sum(b < a for a, b in zip(minutes, minutes[1:])), sum(b == a for a, b in zip(minutes, minutes[1:])), 300)
    for block in (7, 1000):
        r = explore.step_order(readings(spark, data), block).collect()[0]
        assert (r.steps_back, r.repeats, r.row_count) == want
