"""Scopes, reviews, display values, schedule sources, contracts, baselines and build records."""

import datetime as dt
import json
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gridloom.functions import display
from gridloom.operators import expansion, profile, review, terrain
from gridloom.sources import baseline, bundles, contract, schedule
from tests.helpers import reading, readings, rows


def test_ratios_are_rounded_once_from_exact_values(spark):
    rng = random.Random(6)
    cases = [(Decimal("72.8497"), Decimal(100)), (Decimal("0.0005"), Decimal(1)), (Decimal(1), Decimal(3)), (Decimal(0), Decimal(5)), (Decimal(5), Decimal(0)), (Decimal("-1"), Decimal(8)), (None, Decimal(1))]
    cases += [(Decimal(rng.randrange(10**14)).scaleb(-10), Decimal(rng.randrange(1, 10**15)).scaleb(-10)) for _ in range(300)]
    df = spark.createDataFrame([(i, p, w) for i, (p, w) in enumerate(cases)], "i int, p decimal(28,10), w decimal(28,10)")
    got = {r.i: (r.a, r.b) for r in df.select("i", display.ratio(F.col("p"), F.col("w"), 4).alias("a"), display.share_percent(F.col("p"), F.col("w")).alias("b")).collect()}

    def exact(p, w, places):
        if p is None or not w:
            return None
        f = Fraction(p) / Fraction(w)
        return (Decimal(f.numerator * 10**30 // f.denominator).scaleb(-30)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP) if f >= 0 else -exact(-p, w, places)

    for i, (p, w) in enumerate(cases):
        assert got[i][0] == exact(p, w, 4)
        assert got[i][1] == (None if p is None else exact(p * 100, w, 1))
    assert got[0][1] == Decimal("72.8")  # not 72.9, which rounding twice gives


def test_scope_bounds_are_inclusive_and_reach_the_scan(spark, tmp_path):
    data = [reading(i, h, at, 1) for i, (h, at) in enumerate([("A", "2015-01-01 00:00:00"), ("A", "2015-01-02 23:30:00"), ("A", "2015-01-03 00:00:00"), ("B", "2015-01-02 00:00:00"), ("A", None)])]
    readings(spark, data).write.parquet(str(tmp_path / "r"))
    r = spark.read.parquet(str(tmp_path / "r"))
    scope = review.scoped(r, "A", dt.date(2015, 1, 1), dt.date(2015, 1, 2))
    assert rows(scope.select("source_record_no")) == [(0,), (1,)]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = review.scoped(r, "A", dt.date(2015, 1, 1), dt.date(2015, 1, 2))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(observed_at_naive" in plan and "EqualTo(household_id,A)" in plan
    assert review.scoped(r, ["A", "B"]).count() == 5 and review.scoped(r, None, None, dt.date(2015, 1, 1)).count() == 1


def test_days_and_households_for_review(spark):
    at = lambda d, h: f"2015-01-{d:02d} {h // 2:02d}:{30 * (h % 2):02d}:00"
    data = [("A", at(d, h), 1, None) for d in (1, 2, 3, 5, 6) for h in range(48) if (d, h) != (2, 20)]
    data += [("A", at(3, 4), 1, "1.0"), ("A", at(5, 0), 2, None), ("B", at(1, 0), 1, None), ("B", at(1, 1), 1, None), ("C", at(1, 0), None, None), ("C", at(1, 1), 1, None)]
    r = readings(spark, [reading(i, h, t, v, raw) for i, (h, t, v, raw) in enumerate(data)])
    days = {(x.household_id, x.source_date.day): (x.status, x.gaps_observed, x.equivalent_representations, x.contributing_readings) for x in review.day_report(r).collect()}
    assert days["A", 1] == ("boundary date", 0, 0, 48) and days["A", 2] == ("for review", 1, 0, 47) and days["A", 3] == ("recorded", 0, 1, 48)
    assert days["A", 4] == ("no readings recorded", 0, 0, 0) and days["A", 5] == ("conflicting readings", 1, 0, 0) and days["A", 6] == ("boundary date", 0, 0, 48)
    q = review.quality_record(r)
    assert {x.household_id: (x.level, x["items"], x.detail) for x in review.review_status(q).collect()} == {
        "A": ("blocking", 3, "2 gap(s), 1 conflicting timestamp(s)"),
        "B": ("clear", 0, ""),
        "C": ("review", 1, "1 missing value(s)"),
    }
    assert review.conflict_rows(r).count() == 2
    assert rows(review.repeat_examples(r).select("household_id", "row_count")) == [("A", 2), ("A", 2)] and review.repeat_examples(r, conflicting=True).count() == 1
    assert review.quality_record(r.where("false")).count() == 0 and review.day_report(r.where("false")).count() == 0


def test_removed_labels_say_why(spark):
    base = [reading(1, "A", "2015-01-01 00:00:00", 1, member="m1"), reading(2, "A", "2015-01-01 00:30:00", 2, member="m1"), reading(3, "A", "2015-01-01 01:00:00", 3, member="m1")]
    wider = [base[0], reading(4, "A", "2015-01-01 00:00:00", 9, member="m2"), reading(5, "A", "2015-01-01 01:00:00", None, member="m2")]
    b, w = readings(spark, base), readings(spark, wider)
    got = {(r.source_timestamp_text[11:16], r.source_record_no): r.reason for r in expansion.removed_sources(b, w).collect()}
    assert got == {("00:00", 1): "conflict", ("00:00", 4): "conflict", ("00:30", None): "absent", ("01:00", 5): "no_number"}
    assert set(expansion.report(b, w)) >= {"ladder", "reasons", "reconciliation", "removed_sources"}


def test_contradictory_bands_are_an_error(spark):
    at = dt.datetime(2015, 1, 1)
    s = spark.createDataFrame([(at, "Low"), (at, "High")], "schedule_label_naive timestamp_ntz, band_label string")
    with pytest.raises(Exception, match="contradictory bands at 2015-01-01"):
        terrain.schedule_cells(s).collect()


def test_mean_is_rounded_half_even_to_nine_places(spark):
    for values, mean in ((["0.0000000001", "0"], "0.000000000"), (["0.0000000030", "0"], "0.000000002"), (["0.0000000050", "0"], "0.000000002"), (["-0.0000000030", "0"], "-0.000000002"), (["1", "2", "2"], "1.666666667")):
        r = readings(spark, [reading(i, "H", "2015-01-01 00:00:00", v) for i, v in enumerate(values)])
        assert profile.distribution(r).collect()[0].mean == Decimal(mean)


def test_schedules_are_validated_and_never_replaced(spark, tmp_path):
    (tmp_path / "s.csv").write_text("TariffDateTime,Tariff\n2031-05-01 00:00:00,Low\n,\n2031-05-01 00:30:00, High \n")
    t = schedule.resolve_schedule(spark, "file", str(tmp_path / "s.csv"))
    assert rows(t.select("schedule_label_text", "band_label")) == [("2031-05-01 00:00:00", "Low"), ("2031-05-01 00:30:00", "High")]
    assert ", ".join(f"{c} {k}" for c, k in t.dtypes) == schedule.SCHEDULE
    assert schedule.resolve_schedule(spark, "demo").groupBy("band_label").count().count() == 3
    for text in ("A,B\n1,2\n", "TariffDateTime,Tariff\nnever,Low\n", "TariffDateTime,Tariff\n2031-05-01 00:10:00,Low\n", "TariffDateTime,Tariff\n2031-05-01 00:00:00,\n", "TariffDateTime,Tariff\n2031-05-01,Low\n2031-05-01,Low\n", "TariffDateTime,Tariff\n"):
        (tmp_path / "bad.csv").write_text(text)
        with pytest.raises(schedule.ScheduleError):
            schedule.resolve_schedule(spark, "file", str(tmp_path / "bad.csv"))
    for variant in ("Demo", "workbook", ""):
        with pytest.raises(schedule.ScheduleError):
            schedule.resolve_schedule(spark, variant, str(tmp_path / "s.csv"))


def test_prices_are_exact_and_whole(spark):
    day = dt.date(2031, 1, 1)
    p = schedule.price_table(spark, [("G", "Low", Decimal("3.4567"), day, None and day, "e", "c", "v")][:0] + [("G", "Low", Decimal("3.4567"), day, dt.date(2032, 1, 1), "e", "c", "v"), ("S", "All", Decimal("9"), None, None, "e", "c", "v")])
    assert {r.band_label: r.price_gbp_per_kwh for r in p.collect()} == {"Low": Decimal("0.034567"), "All": Decimal("0.090000")}
    with pytest.raises(schedule.ScheduleError):
        schedule.price_table(spark, [("G", "Low", Decimal(1), day, None, "e", "c", "v")])


def test_contracts(spark, tmp_path):
    good = readings(spark, [reading(1, "A", "2015-01-01 00:00:00", 1)]).withColumn("extra", F.lit(1))
    assert contract.staged(good, "readings").columns == list(contract.contract("readings"))
    for bad in (good.drop("load_id"), good.withColumn("source_record_no", F.col("source_record_no").cast("int"))):
        with pytest.raises(AnalysisException):
            contract.staged(bad, "readings")
    good.write.parquet(str(tmp_path / "readings.parquet"))
    good.drop("load_id").write.parquet(str(tmp_path / "x" / "readings.parquet"))
    assert contract.availability(spark, str(tmp_path), "readings") == "ready"
    assert contract.availability(spark, str(tmp_path / "x"), "readings") == contract.availability(spark, str(tmp_path), "dim_tariff_price") == "absent"


def test_baselines_tell_every_field(spark, tmp_path):
    fact = spark.createDataFrame([("h", "Low", Decimal(1), Decimal(2)), ("g", "High", Decimal(3), Decimal(4))], "household_id string, band_label string, consumption_kwh decimal(28,10), energy_charge_gbp decimal(38,16)")
    take = lambda df: baseline.capture({"fact": df}, {"by_band": (df, "band_label")})
    base = take(fact)
    assert baseline.compare(base, take(fact.orderBy("household_id"))) == []
    moved = take(fact.withColumn("consumption_kwh", F.when(F.col("household_id") == "h", 5).otherwise(F.col("consumption_kwh")).cast("decimal(28,10)")))
    assert {d["field"] for d in baseline.compare(base, moved)} == {"/relations/fact/digest", "/totals/by_band/Low/kwh"}
    path = str(tmp_path / "b.json")
    assert baseline.save(spark, path, base) == baseline.save(spark, path, base)
    with pytest.raises(FileExistsError):
        baseline.save(spark, path, moved)
    assert baseline.applicability({"rows": 2, "digest": "x"}, {"rows": 2, "digest": "x"})["verdict"] == "applicable"
    assert baseline.applicability({"rows": 2, "digest": "x"}, {"rows": 3, "digest": "x"})["verdict"] == "mismatched"
    assert baseline.applicability({"rows": 2, "digest": "x"}, {"rows": 2})["verdict"] == "unverifiable"
    assert set(baseline.identity(spark)) == {"code", "policy", "calculation", "model", "runtime"}


def test_attempts_fail_unless_every_node_is_there(spark, tmp_path):
    with baseline.Attempt(spark, str(tmp_path), ["a", "b"]) as run:
        run.node("a")
        run.node("b")
    states = lambda: sorted(json.loads(p.read_text())["state"] for p in (tmp_path / "attempts").glob("*.json"))
    assert states() == ["started", "succeeded"]
    with pytest.raises(RuntimeError), baseline.Attempt(spark, str(tmp_path), ["a", "b"]) as run:
        run.node("a")
    with pytest.raises(ZeroDivisionError), baseline.Attempt(spark, str(tmp_path), []):
        1 / 0
    assert states() == ["failed", "failed", "started", "started", "started", "succeeded"]


def test_reports_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a|c", None)], "k string, v int")
    first = bundles.write_report(str(tmp_path / "r"), "Title", {"one": (df, ["k"])})
    assert first["one"]["rows"] == 2 and "a\\|c" in (tmp_path / "r/report.md").read_text() and bundles.verify_bundle(str(tmp_path / "r")) == []
    df.write.parquet(str(tmp_path / "w" / "t.parquet"))
    seen = bundles.snapshot(str(tmp_path / "w"), str(tmp_path / "copy"))
    assert seen and spark.read.parquet(str(tmp_path / "copy/t.parquet")).count() == 2
    with pytest.raises(FileExistsError):
        bundles.snapshot(str(tmp_path / "w"), str(tmp_path / "copy"))
