"""The scheduled queries under their full schedule, on households with whole days."""

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import compare  # noqa: E402

from gridloom.plans import reference  # noqa: E402

DAY = dt.date(2013, 1, 1)
SCHEDULED = [n.removeprefix("short_") for n in reference.QUERIES if n.startswith("short_")]


@pytest.fixture(scope="module")
def dense_folder(spark, tmp_path_factory):
    """Four households of 230 days: h2 has a run of 99 days only; h3 lacks half of day 40, where the rest is zero, and is zero on days 60 to 62."""
    tmp = str(tmp_path_factory.mktemp("dense"))
    x = spark.range(4 * 230 * 48).selectExpr("id", "id div (230 * 48) AS h", "id div 48 % 230 AS d", "id % 48 AS slot")
    x = x.where("NOT (h = 2 AND d % 100 = 99) AND NOT (h = 3 AND d = 40 AND slot >= 24)")
    kwh = "CAST(CASE WHEN h = 3 AND (d = 40 OR d BETWEEN 60 AND 62) THEN 0 ELSE (h + (d * d) % 13 + slot % 5) / 10 END AS decimal(28,10))"
    label = "CAST('2013-01-01 00:00:00' AS timestamp_ntz) + make_dt_interval(CAST(d AS int), 0, CAST(30 * slot AS int))"
    x.selectExpr(
        "'load-1' AS load_id", "'a' AS archive_name", "concat('m', h % 2) AS member_name", "id AS source_record_no", "concat('h', h) AS household_id", "'ToU' AS tariff_group",
        f"date_format({label}, 'yyyy-MM-dd HH:mm:ss') AS source_timestamp_text", f"{label} AS observed_at_naive", "'unresolved' AS timezone_status", "'unresolved' AS interval_anchor_status",
        "true AS on_half_hour_grid", f"{kwh} AS consumption_kwh", f"CAST({kwh} AS string) AS consumption_raw_text", "'finite_numeric' AS value_category",
    ).write.parquet(f"{tmp}/readings.parquet")
    return tmp


def test_every_horizon_and_candidate_is_tried(spark, dense_folder):
    run = lambda name: reference.QUERIES[name](spark, dense_folder).collect()
    assert {r.horizon for r in run("forecast_mae")} == set(range(1, 8))
    assert {r.weeks for r in run("weeks_sweep")} == {1, 2, 4, 8}
    assert {r.household_id for r in run("forecast_origins")} == {"h0", "h1", "h3"}
    assert run("origin_calendar")[0].origin == DAY + dt.timedelta(27)


def test_a_half_day_is_neither_usable_nor_zero(spark, dense_folder):
    run = lambda name: reference.QUERIES[name](spark, dense_folder).collect()
    assert {r.reason: r.days for r in run("usable_day_reasons")} == {"usable": 4 * 230 - 3, "incomplete": 1}
    assert [(r.household_id, (r.start - DAY).days, r.days) for r in run("zero_day_runs")] == [("h3", 60, 3)]


@pytest.mark.parametrize("name", SCHEDULED)
def test_scheduled_queries_match_their_twins(spark, dense_folder, name):
    import duckdb

    con = duckdb.connect()
    compare.views(con, dense_folder)
    df = reference.QUERIES[name](spark, dense_folder)
    mine, cols = compare.rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(reference.ORACLES[name])
    theirs, other = compare.rows([c[0] for c in cur.description], cur.fetchall())
    assert cols == other and mine
    assert (mine - theirs, theirs - mine) == ({}, {})
