"""The reference's own operators as queries over the meter tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import analytics, daily, digests, expansion, explore, forecast, policy, profile, terrain
from gridloom.sources.tables import table
from gridloom.storage import materialize

# Intervals of a usable day, intervals of a day that may be a zero day, schedule, and weeks to sweep.
FULL = (48, 48, forecast.Schedule(), (1, 2, 4, 8))  # the reference's
# A reduced form, registered as ``short_...``: it runs the same code where tables have few whole days.
SHORT = (24, 1, forecast.Schedule(horizon=2, warmup=3, holdout=2, step=1, min_run=5, weeks=1, window=14, min_usable=3), (1, 2))
BASE_ARCHIVE = "meter-archive-a.zip"
FACT = "fact_interval_charge_scenario"
FACT_COLUMNS = [
    "run_id", "household_id", "tariff_group", "source_timestamp_text", "observed_at_naive", "source_date", "source_hour", "source_month",
    "band_label", "consumption_kwh", "price_pence_per_kwh", "energy_charge_gbp", "assumption_id",
]
SCHEDULE_COLUMNS = ["schedule_label_naive", "schedule_label_text", "band_label", "schedule_year", "on_half_hour_grid", "schedule_source", "source_sha256", "loaded_at_utc"]


def _r(spark, d):
    return table(spark, d, "readings")


def _fact(spark, d):
    return table(spark, d, "fact_interval_charge_scenario")


def _sched(spark, d):
    return table(spark, d, "dim_tariff_band_schedule")


def _cells(spark, d):
    return terrain.dense_cells(_fact(spark, d), _sched(spark, d))


def _sets(spark, d):
    r = _r(spark, d)
    return r.where(F.col("archive_name") == BASE_ARCHIVE), r


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


_Q = {
    "distinct_readings": lambda s, d: policy.distinct_readings(_r(s, d)),
    "distinct_raw_readings": lambda s, d: policy.distinct_raw_readings(_r(s, d)),
    "conflicting_labels": lambda s, d: policy.conflicting_labels(_r(s, d)),
    "key_collisions": lambda s, d: policy.key_collisions(_r(s, d)),
    "conflicting_keys": lambda s, d: policy.key_collisions(_r(s, d)).where("distinct_signatures > 1"),
    "exact_duplicates": lambda s, d: policy.exact_duplicates(_r(s, d)),
    "household_coverage": lambda s, d: policy.household_coverage(_r(s, d)),
    "label_agreement": lambda s, d: policy.label_agreement(_r(s, d)),
    "equivalent_representations": lambda s, d: policy.label_agreement(_r(s, d)).where("kind = 'equivalent_representation'"),
    "dataset_summary": lambda s, d: policy.dataset_summary(_r(s, d)),
    "quality_summary": lambda s, d: policy.quality_summary(_r(s, d)),
    "tariff_group_stability": lambda s, d: policy.group_stability(_r(s, d)),
    "exact_totals": lambda s, d: policy.exact_totals(_r(s, d)),
    "observations_page": lambda s, d: policy.observations_page(_r(s, d), 100, 50),
    "latest_loads": lambda s, d: policy.latest_loads(table(s, d, "load_registry")),
    "step_gaps": lambda s, d: explore.step_gaps(_r(s, d)),
    "off_grid_rows": lambda s, d: explore.off_grid_rows(_r(s, d)),
    "daily_totals": lambda s, d: explore.daily_totals(_r(s, d)),
    "period_summary": lambda s, d: explore.period_summary(_r(s, d)),
    "half_hour_detail": lambda s, d: explore.half_hour_detail(_r(s, d)),
    "preset_window": lambda s, d: explore.preset_window(_r(s, d), 30),
    "step_order_stats": lambda s, d: explore.step_order(_r(s, d)),
    "daily_records": lambda s, d: daily.daily_records(_r(s, d)),
    "value_classification": lambda s, d: profile.value_classes(_r(s, d)),
    "timestamp_classification": lambda s, d: profile.label_classes(_r(s, d)),
    "profile_partitions": lambda s, d: profile.partitions(_r(s, d)),
    "duplicate_stats": lambda s, d: profile.duplicate_stats(_r(s, d)),
    "collision_stats": lambda s, d: profile.collision_stats(_r(s, d)),
    "nearest_rank_percentiles": lambda s, d: profile.nearest_rank_percentiles(_r(s, d)),
    "distribution": lambda s, d: profile.distribution(_r(s, d)),
    "extreme_values": lambda s, d: profile.extreme_values(_r(s, d)),
    "group_values": lambda s, d: profile.group_values(_r(s, d)),
    "member_profile": lambda s, d: profile.member_profile(_r(s, d)),
    "banded_readings": lambda s, d: analytics.banded_readings(_r(s, d), _sched(s, d), table(s, d, "dim_tariff_price")),
    "band_summary": lambda s, d: analytics.band_summary(_fact(s, d)),
    "band_hour_distribution": lambda s, d: analytics.band_by_hour(_fact(s, d)),
    "band_hour_wide": lambda s, d: analytics.band_by_hour_wide(_fact(s, d), ["Low", "Normal", "High"]),
    "monthly_amounts": lambda s, d: analytics.by_month(_fact(s, d)),
    "household_totals": lambda s, d: analytics.household_totals(_fact(s, d)),
    "high_rank": lambda s, d: analytics.high_rank(_fact(s, d)),
    "schedule_distribution": lambda s, d: analytics.schedule_distribution(_sched(s, d)),
    "schedule_totals": lambda s, d: analytics.schedule_totals(_sched(s, d)),
    "schedule_steps": lambda s, d: analytics.schedule_steps(_sched(s, d)),
    "insights": lambda s, d: analytics.insights(_fact(s, d)),
    "long_shares": lambda s, d: analytics.long_shares(_fact(s, d)),
    "terrain_cells": lambda s, d: _cells(s, d),
    "terrain_by_band": lambda s, d: terrain.by_band(_cells(s, d)),
    "terrain_by_month": lambda s, d: terrain.by_month(_cells(s, d)),
    "terrain_peaks": lambda s, d: terrain.peaks(_cells(s, d)),
    "terrain_days": lambda s, d: terrain.day_rows(_cells(s, d)).select("source_date", F.array_join(F.transform("kwh_by_slot", lambda v: F.coalesce(v.cast("string"), F.lit("-"))), ",").alias("kwh_by_slot")),
    "hour_concentration": lambda s, d: terrain.hour_concentration(_sched(s, d)),
    "source_diff_added": lambda s, d: expansion.added(*_sets(s, d)),
    "source_diff_removed": lambda s, d: expansion.removed(*_sets(s, d)),
    "source_diff_changed": lambda s, d: expansion.changed(*_sets(s, d)),
    "source_diff_reconciliation": lambda s, d: expansion.reconciliation(*_sets(s, d)),
    "source_diff_ladder": lambda s, d: expansion.ladder(*_sets(s, d)),
    "source_diff_supplied_by": lambda s, d: expansion.supplied_by(*_sets(s, d)),
    "source_diff_households": lambda s, d: expansion.new_households(*_sets(s, d)),
    "source_diff_repeats": lambda s, d: expansion.repeated_readings(*_sets(s, d)),
    "new_conflicts": lambda s, d: expansion.new_conflicts(*_sets(s, d)),
    "resolved_conflicts": lambda s, d: expansion.resolved_conflicts(*_sets(s, d)),
    "canonical_row_hashes": lambda s, d: digests.row_hashes(_fact(s, d), FACT_COLUMNS),
    "fact_bucket_digests": lambda s, d: digests.bucket_digests(_fact(s, d), FACT_COLUMNS),
    "fact_evidence": lambda s, d: digests.evidence(_fact(s, d).select(*FACT_COLUMNS), FACT, ("run_id",)),
    "schedule_evidence": lambda s, d: digests.evidence(_sched(s, d).select(*SCHEDULE_COLUMNS), "dim_tariff_band_schedule", ("loaded_at_utc",)),
    "series_digests": lambda s, d: digests.series_digests(daily.with_usability(daily.daily_records(_r(s, d)), 24)),
    "fact_totals_by_band": lambda s, d: digests.grouped_totals(_fact(s, d), "band_label"),
    "fact_totals_by_household": lambda s, d: digests.grouped_totals(_fact(s, d), "household_id"),
    "fact_totals_by_month": lambda s, d: digests.grouped_totals(_fact(s, d), "source_month"),
    "fact_described": lambda s, d: digests.described(_fact(s, d)),
    "fact_wrong_charges": lambda s, d: digests.wrong_products(_fact(s, d), table(s, d, "dim_tariff_price")),
    "fact_copies_both_ways": lambda s, d: digests.both_ways(_fact(s, d), table(s, d, "fact_interval_charge_replica"), FACT_COLUMNS),
    "fact_required_bands": lambda s, d: digests.required_values(_fact(s, d), ["band_label"], [("Low",), ("Normal",), ("High",)]),
    "archives_share_labels": lambda s, d: digests.shared_keys(_r(s, d).where(F.col("archive_name") == BASE_ARCHIVE), _r(s, d).where(F.col("archive_name") != BASE_ARCHIVE), ["household_id", "source_timestamp_text"]),
    "fact_not_unique": lambda s, d: digests.not_unique(_fact(s, d), ["household_id", "source_timestamp_text"]),
    "fact_null_counts": lambda s, d: digests.null_counts(_fact(s, d), FACT_COLUMNS),
    "bands_not_accepted": lambda s, d: digests.not_accepted(_fact(s, d), "band_label", ["Low", "Normal", "High"]),
    "fk_violations": lambda s, d: digests.orphans(_r(s, d), _sched(s, d), "observed_at_naive", "schedule_label_naive"),
    "fact_fk_violations": lambda s, d: digests.orphans(_fact(s, d), _sched(s, d), "observed_at_naive", "schedule_label_naive"),
    "accounting_membership": lambda s, d: digests.membership(policy.distinct_raw_readings(_r(s, d)), _fact(s, d).join(_r(s, d).select("household_id", "source_timestamp_text", "consumption_raw_text"), ["household_id", "source_timestamp_text"]), policy.RAW_KEY),
}


def _scheduled(intervals: int, zero_intervals: int, schedule: forecast.Schedule, sweep: tuple[int, ...]) -> dict:
    """The queries that depend on a usable day's intervals, on the zero days' and on a schedule."""

    def days(spark, d, n=intervals):
        return daily.with_usability(daily.daily_records(_r(spark, d)), n)

    def written(spark, d):
        """The daily records, written once for those that need the calendar of all households first."""
        return materialize(days(spark, d).select("household_id", "source_date", "kwh", "unusable_reason"), "days")

    return {
        "usable_day_reasons": lambda s, d: days(s, d).groupBy(F.coalesce("unusable_reason", F.lit("usable")).alias("reason")).agg(F.count("*").alias("days")),
        "longest_usable_run": lambda s, d: daily.longest_runs(days(s, d).where("unusable_reason is null")),
        "feasibility": lambda s, d: daily.feasibility(days(s, d)),
        "zero_day_runs": lambda s, d: daily.zero_runs(days(s, d, zero_intervals)),
        "zero_days_by_household": lambda s, d: daily.zero_days_by_household(daily.zero_runs(days(s, d, zero_intervals))),
        "zero_days_summary": lambda s, d: daily.zero_days_summary(daily.zero_runs(days(s, d, zero_intervals))),
        "forecast_origins": lambda s, d: forecast.origins(days(s, d), schedule),
        "forecast_predictions": lambda s, d: _rounded(forecast.backtest(days(s, d), schedule), "actual", "predicted", "abs_error"),
        "forecast_mae": lambda s, d: forecast.errors(forecast.backtest(days(s, d), schedule), ["split", "model", "horizon"]),
        "forecast_common_frame": lambda s, d: forecast.errors(forecast.common_frame(forecast.wide_cases(days(s, d), schedule)), ["model"]),
        "forecast_exclusions": lambda s, d: forecast.exclusions(forecast.backtest(days(s, d), schedule)),
        "forecast_split_counts": lambda s, d: forecast.split_counts(forecast.wide_cases(days(s, d), schedule)),
        "forecast_overlap": lambda s, d: forecast.overlap(written(s, d), schedule),
        "cohort_composition": lambda s, d: forecast.cohort_composition(_r(s, d), days(s, d), schedule),
        "forecast_wide": lambda s, d: _rounded(forecast.observed_vs_predicted(forecast.wide_cases(days(s, d), schedule)), "actual", *forecast.MODELS),
        "weeks_sweep": lambda s, d: forecast.weeks_sweep(days(s, d), schedule, sweep),
        "best_weeks": lambda s, d: forecast.best_weeks(forecast.weeks_sweep(days(s, d), schedule, sweep)),
        "worst_days": lambda s, d: forecast.worst_cases(forecast.backtest(days(s, d), schedule)).select("household_id", "origin", "horizon", "model", F.round("abs_error", 6).alias("abs_error")),
        "first_eligible": lambda s, d: forecast.first_eligible(days(s, d), schedule),
        "origin_calendar": lambda s, d: forecast.origin_calendar(days(s, d), schedule),
        "prior_eligibility_cases": lambda s, d: _rounded(forecast.prior_cases(written(s, d), schedule), *forecast.MODELS),
        "prior_coverage": lambda s, d: forecast.prior_coverage(written(s, d), schedule),
        "prior_report": lambda s, d: forecast.prior_report(written(s, d), schedule),
    }


QUERIES = _Q | _scheduled(*FULL) | {f"short_{name}": q for name, q in _scheduled(*SHORT).items()}

_SIG = "coalesce(CAST(consumption_kwh AS VARCHAR), '~' || value_category)"
_CONF = f"(SELECT household_id, source_timestamp_text FROM readings GROUP BY 1, 2 HAVING count(DISTINCT {_SIG}) > 1)"
_AGREE = f"""SELECT household_id, source_timestamp_text, count(*) AS rows_raw, count(DISTINCT consumption_raw_text) AS distinct_texts, count(DISTINCT {_SIG}) AS distinct_signatures,
 count(DISTINCT member_name) AS members_involved, min(member_name) AS first_member, min(source_record_no) AS first_record_no, coalesce(array_to_string(list_sort(list(DISTINCT consumption_raw_text) FILTER (consumption_raw_text IS NOT NULL)), ' | '), '') AS texts,
 CASE WHEN count(DISTINCT {_SIG}) > 1 THEN 'conflict' WHEN count(DISTINCT consumption_raw_text) > 1 THEN 'equivalent_representation' ELSE 'exact_duplicate' END AS kind FROM readings GROUP BY 1, 2 HAVING count(*) > 1"""
_COLL = f"SELECT household_id, source_timestamp_text, count(*) AS row_count, count(DISTINCT {_SIG}) AS distinct_signatures, count(DISTINCT member_name) AS members FROM readings GROUP BY 1, 2 HAVING count(*) > 1"
_DAYS = f"""days AS (SELECT household_id, CAST(observed_at_naive AS DATE) AS source_date, CAST(sum(kwh) FILTER (grid) AS DECIMAL(38,10)) AS kwh, count(kwh) FILTER (grid) AS grid_intervals, CAST(sum(blank) AS BIGINT) AS non_numeric_rows,
 CAST(coalesce(sum(n) FILTER (NOT grid), 0) AS BIGINT) AS off_grid_rows, bool_or(conflict) AS has_conflict FROM (
 SELECT household_id, observed_at_naive, coalesce(on_half_hour_grid, false) AS grid, count(*) AS n, count(*) FILTER (consumption_kwh IS NULL) AS blank, coalesce(min({_SIG}) <> max({_SIG}), false) AS conflict, sum(DISTINCT consumption_kwh) AS kwh
 FROM readings WHERE observed_at_naive IS NOT NULL AND household_id IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


def _judged(n: int) -> str:
    return f"WITH {_DAYS}, judged AS (SELECT *, CASE WHEN grid_intervals < {n} THEN 'incomplete' WHEN non_numeric_rows > 0 THEN 'non_numeric' WHEN has_conflict THEN 'conflict' END AS unusable_reason FROM days)"


_RUNS = """, usable AS (SELECT household_id, source_date, CAST(kwh AS DOUBLE) AS kwh FROM judged WHERE unusable_reason IS NULL),
runs AS (SELECT household_id, min(source_date) AS start, max(source_date) AS "end", count(*) AS days FROM (SELECT *, source_date - CAST(row_number() OVER (PARTITION BY household_id ORDER BY source_date) AS INTEGER) AS k FROM usable) GROUP BY household_id, k),
longest AS (SELECT household_id, start, "end", days FROM (SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY days DESC, start) AS rn FROM runs) WHERE rn = 1)"""
_WORDS = {1: "one", 2: "two", 4: "four", 8: "eight"}
_SETS = "base AS (SELECT * FROM readings WHERE archive_name = 'meter-archive-a.zip')"
_SETTLED = ", ".join(
    f"{n} AS (SELECT household_id, source_timestamp_text, max(consumption_kwh) AS kwh FROM {src} WHERE household_id IS NOT NULL AND source_timestamp_text IS NOT NULL GROUP BY 1, 2 HAVING min({_SIG}) = max({_SIG}) AND max(consumption_kwh) IS NOT NULL)"
    for n, src in (("b", "base"), ("w", "readings"))
)
_DIFF = f"WITH {_SETS}, {_SETTLED} "
_CONF_SETS = f"WITH {_SETS}, cb AS (SELECT household_id, source_timestamp_text FROM base GROUP BY 1, 2 HAVING count(DISTINCT {_SIG}) > 1), cw AS (SELECT * FROM {_CONF}) "
_CELLS = """WITH span AS (SELECT CAST(min(schedule_label_naive) AS DATE) AS lo, CAST(max(schedule_label_naive) AS DATE) AS hi FROM dim_tariff_band_schedule),
grid AS (SELECT lo, source_date, s.slot FROM (SELECT lo, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS source_date FROM span), (SELECT unnest(generate_series(0, 47)) AS slot) s),
sc AS (SELECT CAST(schedule_label_naive AS DATE) AS source_date, CAST(hour(schedule_label_naive) * 2 + minute(schedule_label_naive) // 30 AS BIGINT) AS slot, min(band_label) AS band_label FROM dim_tariff_band_schedule GROUP BY 1, 2),
fc AS (SELECT source_date, CAST(hour(observed_at_naive) * 2 + minute(observed_at_naive) // 30 AS BIGINT) AS slot, count(*) AS row_count, count(DISTINCT household_id) AS households, sum(consumption_kwh) AS kwh, sum(energy_charge_gbp) AS amount_gbp FROM fact_interval_charge_scenario WHERE observed_at_naive IS NOT NULL GROUP BY 1, 2),
cells AS (SELECT CAST((g.source_date - g.lo) * 48 + g.slot AS BIGINT) AS cell, g.source_date, g.slot, sc.band_label, coalesce(fc.row_count, 0) AS row_count, coalesce(fc.households, 0) AS households, fc.kwh, fc.amount_gbp FROM grid g LEFT JOIN sc USING (source_date, slot) LEFT JOIN fc ON fc.source_date = g.source_date AND fc.slot = g.slot)
"""
_FACT = "fact_interval_charge_scenario"
_SHARE = lambda a, b: f"round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 6)"
_BANDS = f"SELECT *, {_SHARE('kwh', 'sum(kwh) OVER ()')} AS kwh_share, {_SHARE('amount_gbp', 'sum(amount_gbp) OVER ()')} AS amount_share FROM (SELECT band_label, count(*) AS row_count, count(DISTINCT household_id) AS households, sum(consumption_kwh) AS kwh, sum(energy_charge_gbp) AS amount_gbp FROM {_FACT} GROUP BY 1)"
_STRIP = r"regexp_replace({0}, '^[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+|[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+$', '', 'g')".replace("{0}", "consumption_raw_text").replace("{{", "{").replace("}}", "}")
_DAILY_TOTALS = f"""WITH labels AS (SELECT household_id, CAST(observed_at_naive AS DATE) AS source_date, source_timestamp_text, on_half_hour_grid AS grid, count(*) AS n, count(DISTINCT ({_SIG}, consumption_kwh)) AS readings, min({_SIG}) <> max({_SIG}) AS conflict, sum(DISTINCT consumption_kwh) AS kwh, max(CASE WHEN consumption_kwh IS NULL THEN 1 ELSE 0 END) AS any_missing,
 count(DISTINCT CASE WHEN consumption_kwh IS NULL THEN {_SIG} END) AS missing FROM readings WHERE observed_at_naive IS NOT NULL AND household_id IS NOT NULL GROUP BY 1, 2, 3, 4),
days AS (SELECT household_id, source_date, sum(n) AS raw_rows, sum(readings) AS distinct_readings, sum(missing) AS missing_values, coalesce(sum(n) FILTER (NOT coalesce(grid, false)), 0) AS off_grid_rows, sum(kwh) FILTER (coalesce(grid, false)) AS grid_kwh, bool_or(conflict) AS has_conflict FROM labels GROUP BY 1, 2),
spans AS (SELECT household_id, min(source_date) AS lo, max(source_date) AS hi FROM days GROUP BY 1), cal AS (SELECT household_id, lo, hi, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS source_date FROM spans),
f AS (SELECT cal.household_id, cal.source_date, lo, hi, raw_rows, distinct_readings, missing_values, off_grid_rows, grid_kwh, has_conflict, CASE WHEN raw_rows IS NULL OR (grid_kwh IS NULL AND NOT has_conflict) THEN 'none' WHEN has_conflict THEN 'withheld' ELSE 'published' END AS total_status FROM cal LEFT JOIN days ON days.household_id = cal.household_id AND days.source_date = cal.source_date),
daily AS (SELECT household_id, source_date, CAST(coalesce(raw_rows, 0) AS BIGINT) AS raw_rows, CAST(coalesce(distinct_readings, 0) AS BIGINT) AS distinct_readings, CAST(coalesce(missing_values, 0) AS BIGINT) AS missing_values, CAST(coalesce(off_grid_rows, 0) AS BIGINT) AS off_grid_rows,
 CAST(coalesce(raw_rows, 0) - coalesce(distinct_readings, 0) AS BIGINT) AS duplicates_removed, coalesce(has_conflict, false) AS has_conflict, raw_rows IS NOT NULL AS has_rows, source_date = lo OR source_date = hi AS is_boundary_day, total_status, CAST(CASE WHEN total_status = 'published' THEN grid_kwh END AS DECIMAL(38,10)) AS recorded_kwh FROM f)
"""


_DIGEST = "count(*) AS row_count, sha256(count(*) || ',' || " + " || ',' || ".join(f"coalesce(sum(CAST('0x' || h[{16 * i + 1}:{16 * i + 16}] AS UBIGINT)), 0)" for i in range(4)) + ") AS digest"
_TYPES = {"observed_at_naive": "timestamp_ntz", "source_date": "date", "source_hour": "smallint", "source_month": "smallint", "consumption_kwh": "decimal(28,10)", "price_pence_per_kwh": "decimal(9,4)", "energy_charge_gbp": "decimal(38,16)", "schedule_label_naive": "timestamp_ntz", "schedule_year": "int", "on_half_hour_grid": "boolean"}


def _types(cols: list[str]) -> str:
    return ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in cols)


def _hash(cols: list[str]) -> str:
    one = " || ".join(f"CASE WHEN {c} IS NULL THEN 'N;' ELSE length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) || ';' END" for c in cols)
    return f"sha256({one})"


ORACLES = {
    "distinct_readings": f"SELECT DISTINCT {', '.join(policy.DISTINCT_COLUMNS)}, {_SIG} AS value_signature FROM readings",
    "distinct_raw_readings": "SELECT DISTINCT household_id, tariff_group, source_timestamp_text, consumption_raw_text FROM readings",
    "conflicting_labels": f"SELECT * FROM {_CONF}",
    "key_collisions": _COLL,
    "conflicting_keys": f"SELECT * FROM ({_COLL}) WHERE distinct_signatures > 1",
    "exact_duplicates": "SELECT household_id, tariff_group, source_timestamp_text, consumption_raw_text, count(*) AS row_count, count(*) - 1 AS extra_rows FROM readings GROUP BY 1, 2, 3, 4 HAVING count(*) > 1",
    "household_coverage": "SELECT household_id, count(*) AS row_count, count(DISTINCT member_name) AS members, min(source_timestamp_text) AS first_label, max(source_timestamp_text) AS last_label, count(*) FILTER (value_category = 'finite_numeric') AS finite_values, count(*) FILTER (value_category = 'null_token') AS null_values, count(*) FILTER (consumption_kwh = 0) AS zero_values FROM readings GROUP BY 1",
    "label_agreement": _AGREE,
    "equivalent_representations": f"SELECT * FROM ({_AGREE}) WHERE kind = 'equivalent_representation'",
    "dataset_summary": "SELECT count(*) AS row_count, count(DISTINCT household_id) AS households, count(DISTINCT household_id) FILTER (tariff_group = 'ToU') AS variable_households, count(DISTINCT member_name) AS members, min(observed_at_naive) AS first_at, max(observed_at_naive) AS last_at FROM readings",
    "quality_summary": f"""WITH l AS (SELECT household_id, source_timestamp_text, count(*) AS n, count(DISTINCT (tariff_group, {_SIG})) AS s, min({_SIG}) <> max({_SIG}) AS conflict, count(*) FILTER (value_category = 'finite_numeric') AS f, count(*) FILTER (value_category = 'null_token') AS nu, count(*) FILTER (consumption_kwh = 0) AS z, count(*) FILTER (NOT coalesce(on_half_hour_grid, false)) AS o,
 count(*) - count(DISTINCT (tariff_group, consumption_raw_text, {_SIG}, value_category, on_half_hour_grid)) AS e FROM readings GROUP BY 1, 2)
 SELECT household_id, CAST(sum(n) AS BIGINT) AS observed_records, CAST(sum(s) AS BIGINT) AS distinct_readings, CAST(sum(e) AS BIGINT) AS exact_duplicate_extras, CAST(sum(f) AS BIGINT) AS finite_values, CAST(sum(nu) AS BIGINT) AS null_values, CAST(sum(z) AS BIGINT) AS zero_values, CAST(sum(o) AS BIGINT) AS off_grid_rows, count(*) FILTER (n > 1) AS colliding_labels, count(*) FILTER (conflict) AS conflicting_labels FROM l GROUP BY 1""",
    "tariff_group_stability": "SELECT household_id, count(DISTINCT tariff_group) AS groups, array_to_string(list_sort(list(DISTINCT tariff_group)), ' | ') AS seen FROM readings GROUP BY 1 HAVING count(DISTINCT tariff_group) > 1",
    "exact_totals": "SELECT household_id, sum(consumption_kwh) AS total_kwh, count(*) AS readings FROM (SELECT DISTINCT household_id, source_timestamp_text, consumption_kwh FROM readings WHERE consumption_kwh IS NOT NULL AND on_half_hour_grid) GROUP BY 1",
    "observations_page": "SELECT household_id, observed_at_naive, source_record_no, member_name, consumption_raw_text FROM readings ORDER BY observed_at_naive NULLS LAST, source_record_no NULLS LAST, member_name NULLS LAST LIMIT 50 OFFSET 100",
    "latest_loads": "SELECT archive_name, member_name, load_id, loaded_at_utc, records_published FROM (SELECT *, row_number() OVER (PARTITION BY archive_name, member_name ORDER BY loaded_at_utc DESC, load_id DESC) AS rn FROM load_registry WHERE status = 'published') WHERE rn = 1",
    "step_gaps": "WITH l AS (SELECT DISTINCT household_id, observed_at_naive AS t FROM readings WHERE on_half_hour_grid AND observed_at_naive IS NOT NULL AND household_id IS NOT NULL), g AS (SELECT household_id, lag(t) OVER (PARTITION BY household_id ORDER BY t) AS p, t FROM l) SELECT household_id, p AS from_timestamp, t AS to_timestamp, date_diff('second', p, t) AS step_seconds, CAST(t AS DATE) AS attributed_date FROM g WHERE date_diff('second', p, t) > 1800",
    "off_grid_rows": "SELECT DISTINCT household_id, source_timestamp_text, observed_at_naive, consumption_kwh FROM readings WHERE observed_at_naive IS NOT NULL AND NOT coalesce(on_half_hour_grid, false)",
    "daily_totals": _DAILY_TOTALS + "SELECT * FROM daily",
    "period_summary": _DAILY_TOTALS
    + "SELECT household_id, count(*) FILTER (has_rows) AS days_with_rows, count(*) FILTER (NOT has_rows) AS days_without_rows, CAST(sum(missing_values) AS BIGINT) AS missing_values, CAST(sum(duplicates_removed) AS BIGINT) AS duplicates_removed, count(*) FILTER (has_conflict) AS conflict_days, CASE WHEN bool_or(has_conflict) THEN 'conflicting labels' END AS withheld_reason, CAST(CASE WHEN NOT bool_or(has_conflict) THEN sum(recorded_kwh) END AS DECIMAL(38,10)) AS total_kwh FROM daily GROUP BY 1",
    "half_hour_detail": f"WITH s AS (SELECT DISTINCT household_id, observed_at_naive, consumption_kwh FROM readings r WHERE on_half_hour_grid AND observed_at_naive IS NOT NULL AND consumption_kwh IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_CONF} c WHERE c.household_id = r.household_id AND c.source_timestamp_text = r.source_timestamp_text)) SELECT *, coalesce(date_diff('second', lag(observed_at_naive) OVER (PARTITION BY household_id ORDER BY observed_at_naive), observed_at_naive) > 1800, false) AS breaks_before FROM s",
    "preset_window": "SELECT household_id, CAST(min(observed_at_naive) AS DATE) AS first_date, CAST(max(observed_at_naive) AS DATE) AS last_date, greatest(CAST(min(observed_at_naive) AS DATE), CAST(max(observed_at_naive) AS DATE) - 29) AS window_start FROM readings WHERE observed_at_naive IS NOT NULL GROUP BY 1",
    "step_order_stats": "SELECT household_id, count(*) FILTER (t < p) AS steps_back, count(*) FILTER (t = p) AS repeats, count(*) AS row_count FROM (SELECT household_id, observed_at_naive AS t, lag(observed_at_naive) OVER (PARTITION BY household_id ORDER BY source_record_no) AS p FROM readings WHERE observed_at_naive IS NOT NULL AND source_record_no IS NOT NULL) GROUP BY 1",
    "daily_records": f"WITH {_DAYS} SELECT * FROM days",
    "value_classification": f"SELECT value_category AS category, count(*) AS row_count, count(*) FILTER ({_STRIP} <> consumption_raw_text) AS padded FROM readings GROUP BY 1",
    "timestamp_classification": "SELECT CASE WHEN observed_at_naive IS NULL THEN 'invalid' WHEN on_half_hour_grid THEN 'on_grid' ELSE 'off_grid' END AS label_class, count(*) AS row_count FROM readings GROUP BY 1",
    "profile_partitions": "SELECT count(*) AS row_count, count(*) FILTER (value_category = 'finite_numeric') AS finite_values, count(*) FILTER (value_category <> 'finite_numeric') AS other_values, count(*) FILTER (on_half_hour_grid) AS on_grid, count(*) FILTER (NOT on_half_hour_grid) AS off_grid, count(*) FILTER (on_half_hour_grid IS NULL) AS without_instant, count(*) FILTER (consumption_kwh < 0) AS negative, count(*) FILTER (consumption_kwh = 0) AS zero FROM readings",
    "duplicate_stats": "SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_involved FROM (SELECT count(*) AS n FROM readings GROUP BY household_id, tariff_group, source_timestamp_text, consumption_raw_text HAVING count(*) > 1)",
    "collision_stats": "SELECT count(*) AS keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_involved, count(*) FILTER (v > 1 OR t > 1) AS disagreeing_keys FROM (SELECT count(*) AS n, count(DISTINCT coalesce('num:' || CAST(consumption_kwh AS VARCHAR), 'raw:' || consumption_raw_text)) AS v, count(DISTINCT tariff_group) AS t FROM readings GROUP BY household_id, source_timestamp_text HAVING count(*) > 1)",
    "nearest_rank_percentiles": "WITH v AS (SELECT consumption_kwh AS value, row_number() OVER (ORDER BY consumption_kwh) AS rn, count(*) OVER () AS n FROM readings WHERE consumption_kwh IS NOT NULL), p AS (SELECT CAST(unnest([1, 5, 25, 50, 75, 95, 99]) AS BIGINT) AS percent) SELECT percent, rn AS rank, value FROM v, p WHERE rn = (percent * n + 99) // 100",
    "distribution": "SELECT count(consumption_kwh) AS finite_values, min(consumption_kwh) AS least, max(consumption_kwh) AS greatest, CAST(max(consumption_kwh) - min(consumption_kwh) AS DECIMAL(38,10)) AS value_range, sum(consumption_kwh) AS total, CAST(CASE WHEN count(consumption_kwh) > 0 THEN round(CAST(sum(consumption_kwh) AS DOUBLE) / count(consumption_kwh), 9) END AS DECIMAL(28,9)) AS mean FROM readings",
    "extreme_values": "SELECT source_record_no, household_id, consumption_kwh FROM readings WHERE consumption_kwh IS NOT NULL ORDER BY consumption_kwh DESC, source_record_no LIMIT 5",
    "group_values": "SELECT tariff_group, count(*) AS row_count, count(DISTINCT household_id) AS households FROM readings GROUP BY 1",
    "member_profile": "SELECT archive_name, member_name, count(*) AS row_count, count(DISTINCT household_id) AS households, min(observed_at_naive) AS first_at, max(observed_at_naive) AS last_at, count(consumption_kwh) AS finite_values, sum(consumption_kwh) AS total_kwh FROM readings GROUP BY 1, 2",
    "banded_readings": f"""WITH x AS (SELECT DISTINCT {', '.join(policy.DISTINCT_COLUMNS)}, {_SIG} AS value_signature FROM readings), c AS (SELECT min(schedule_label_naive) AS lo, max(schedule_label_naive) AS hi FROM dim_tariff_band_schedule)
 SELECT x.*, s.band_label, p.price_gbp_per_kwh, k.household_id IS NOT NULL AS is_conflict, NOT coalesce(x.observed_at_naive BETWEEN c.lo AND c.hi, false) AS outside_schedule, NOT coalesce(x.on_half_hour_grid, false) AS is_off_grid, coalesce(x.value_category <> 'finite_numeric', true) OR x.consumption_kwh IS NULL AS is_missing_value, s.band_label IS NULL AS is_unmatched_label, s.band_label IS NOT NULL AND p.price_gbp_per_kwh IS NULL AS is_unpriced_band, CAST(x.consumption_kwh * p.price_gbp_per_kwh AS DECIMAL(38,16)) AS amount_gbp FROM x CROSS JOIN c
 LEFT JOIN dim_tariff_band_schedule s ON s.schedule_label_naive = x.observed_at_naive LEFT JOIN {_CONF} k ON k.household_id = x.household_id AND k.source_timestamp_text = x.source_timestamp_text
 LEFT JOIN dim_tariff_price p ON p.tariff_group = x.tariff_group AND p.band_label = s.band_label AND CAST(x.observed_at_naive AS DATE) >= p.effective_from AND CAST(x.observed_at_naive AS DATE) < p.effective_until""",
    "band_summary": _BANDS,
    "band_hour_distribution": f"SELECT band_label, CAST(source_hour AS BIGINT) AS source_hour, count(*) AS row_count, sum(consumption_kwh) AS kwh FROM {_FACT} GROUP BY 1, 2",
    "band_hour_wide": f'SELECT CAST(source_hour AS BIGINT) AS source_hour, sum(consumption_kwh) FILTER (band_label = \'Low\') AS "Low", sum(consumption_kwh) FILTER (band_label = \'Normal\') AS "Normal", sum(consumption_kwh) FILTER (band_label = \'High\') AS "High" FROM {_FACT} GROUP BY 1',
    "monthly_amounts": f"SELECT CAST(source_month AS BIGINT) AS source_month, band_label, count(*) AS row_count, sum(consumption_kwh) AS kwh, sum(energy_charge_gbp) AS amount_gbp FROM {_FACT} GROUP BY 1, 2",
    "household_totals": f"SELECT household_id, count(*) AS row_count, min(source_date) AS first_date, max(source_date) AS last_date, sum(consumption_kwh) AS kwh, sum(energy_charge_gbp) AS amount_gbp FROM {_FACT} GROUP BY 1",
    "high_rank": f"SELECT household_id, band_share, row_number() OVER (ORDER BY band_share DESC, household_id) AS rank FROM (SELECT household_id, {_SHARE('coalesce(sum(consumption_kwh) FILTER (band_label = ' + chr(39) + 'High' + chr(39) + '), 0)', 'sum(consumption_kwh)')} AS band_share FROM {_FACT} GROUP BY 1) WHERE band_share IS NOT NULL",
    "schedule_distribution": "SELECT band_label, month(schedule_label_naive) AS month, hour(schedule_label_naive) AS hour, count(*) AS slots FROM dim_tariff_band_schedule GROUP BY 1, 2, 3",
    "schedule_totals": f"SELECT band_label, slots, slots / 2.0 AS hours, {_SHARE('slots', 'sum(slots) OVER ()')} AS slot_share FROM (SELECT band_label, count(*) AS slots FROM dim_tariff_band_schedule GROUP BY 1)",
    "schedule_steps": "SELECT date_diff('second', t, n) AS step_seconds, count(*) AS steps FROM (SELECT schedule_label_naive AS t, lead(schedule_label_naive) OVER (ORDER BY schedule_label_naive) AS n FROM dim_tariff_band_schedule) WHERE n IS NOT NULL GROUP BY 1",
    "insights": f"SELECT (SELECT band_label FROM ({_BANDS}) ORDER BY amount_share - kwh_share DESC, band_label DESC LIMIT 1) AS dearest_band, (SELECT CAST(source_hour AS BIGINT) FROM {_FACT} GROUP BY 1 ORDER BY sum(consumption_kwh) DESC NULLS LAST, 1 DESC LIMIT 1) AS peak_hour, (SELECT household_id FROM {_FACT} GROUP BY 1 ORDER BY count(*), 1 LIMIT 1) AS fewest, (SELECT household_id FROM {_FACT} GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1) AS most",
    "long_shares": f"SELECT band_label, 'kwh_share' AS measure, kwh_share AS share FROM ({_BANDS}) UNION ALL SELECT band_label, 'amount_share', amount_share FROM ({_BANDS})",
    "terrain_cells": _CELLS + "SELECT * FROM cells",
    "terrain_by_band": _CELLS + "SELECT band_label, count(*) AS slots, count(*) FILTER (row_count > 0) AS covered_slots, sum(kwh) AS kwh, sum(amount_gbp) AS amount_gbp FROM cells GROUP BY 1",
    "terrain_by_month": _CELLS + "SELECT month(source_date) AS month, CAST(sum(row_count) AS BIGINT) AS row_count, min(households) AS least_households, max(households) AS most_households, sum(kwh) AS kwh, sum(amount_gbp) AS amount_gbp FROM cells GROUP BY 1",
    "terrain_peaks": _CELLS
    + "SELECT * FROM (SELECT 'kwh' AS measure, cell, source_date, slot, CAST(kwh AS DECIMAL(38,16)) AS value FROM cells WHERE kwh IS NOT NULL ORDER BY kwh DESC, cell LIMIT 1) UNION ALL SELECT * FROM (SELECT 'amount_gbp', cell, source_date, slot, CAST(amount_gbp AS DECIMAL(38,16)) FROM cells WHERE amount_gbp IS NOT NULL ORDER BY amount_gbp DESC, cell LIMIT 1)",
    "terrain_days": _CELLS + "SELECT source_date, string_agg(coalesce(CAST(kwh AS VARCHAR), '-'), ',' ORDER BY slot) AS kwh_by_slot FROM cells GROUP BY 1",
    "hour_concentration": "SELECT hour, slots, CAST(sum(slots) OVER (ORDER BY slots DESC, hour ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, row_number() OVER (ORDER BY slots DESC, hour) AS place, CAST(sum(slots) OVER () AS BIGINT) AS all_slots FROM (SELECT hour(schedule_label_naive) AS hour, count(*) AS slots FROM dim_tariff_band_schedule WHERE band_label = 'High' GROUP BY 1)",
    "source_diff_added": _DIFF + "SELECT w.* FROM w ANTI JOIN b USING (household_id, source_timestamp_text)",
    "source_diff_removed": _DIFF + "SELECT b.* FROM b ANTI JOIN w USING (household_id, source_timestamp_text)",
    "source_diff_changed": _DIFF + "SELECT w.household_id, w.source_timestamp_text, w.kwh, b.kwh AS base_kwh FROM w JOIN b USING (household_id, source_timestamp_text) WHERE w.kwh <> b.kwh",
    "source_diff_reconciliation": _DIFF
    + "SELECT household_id, CAST(coalesce(sum(b.kwh), 0) AS DECIMAL(38,10)) AS base_kwh, CAST(coalesce(sum(w.kwh) FILTER (b.kwh IS NULL), 0) AS DECIMAL(38,10)) AS added_kwh, CAST(coalesce(sum(b.kwh) FILTER (w.kwh IS NULL), 0) AS DECIMAL(38,10)) AS removed_kwh, CAST(coalesce(sum(w.kwh - b.kwh), 0) AS DECIMAL(38,10)) AS changed_kwh, CAST(coalesce(sum(w.kwh), 0) AS DECIMAL(38,10)) AS wider_kwh, CAST(0 AS DECIMAL(38,10)) AS residual FROM b FULL JOIN w USING (household_id, source_timestamp_text) GROUP BY 1",
    "source_diff_ladder": f"WITH {_SETS} SELECT 'base' AS side, count(*) AS row_count, count(DISTINCT (household_id, source_timestamp_text, {_SIG})) AS distinct_readings, count(DISTINCT household_id) AS households, count(DISTINCT member_name) AS members FROM base UNION ALL SELECT 'wider', count(*), count(DISTINCT (household_id, source_timestamp_text, {_SIG})), count(DISTINCT household_id), count(DISTINCT member_name) FROM readings",
    "source_diff_supplied_by": _DIFF + "SELECT household_id, member_name, count(DISTINCT source_timestamp_text) AS labels FROM readings SEMI JOIN (SELECT w.household_id, w.source_timestamp_text FROM w ANTI JOIN b USING (household_id, source_timestamp_text)) USING (household_id, source_timestamp_text) GROUP BY 1, 2",
    "source_diff_households": f"WITH {_SETS} SELECT DISTINCT household_id FROM readings WHERE household_id IS NOT NULL AND household_id NOT IN (SELECT household_id FROM base WHERE household_id IS NOT NULL)",
    "source_diff_repeats": f"WITH {_SETS} SELECT member_name, count(*) AS row_count FROM readings r WHERE member_name NOT IN (SELECT member_name FROM base) AND EXISTS (SELECT 1 FROM base b WHERE b.household_id = r.household_id AND b.source_timestamp_text = r.source_timestamp_text AND coalesce(CAST(b.consumption_kwh AS VARCHAR), '~' || b.value_category) = coalesce(CAST(r.consumption_kwh AS VARCHAR), '~' || r.value_category)) GROUP BY 1",
    "new_conflicts": _CONF_SETS + "SELECT * FROM cw EXCEPT SELECT * FROM cb",
    "resolved_conflicts": _CONF_SETS + "SELECT * FROM cb EXCEPT SELECT * FROM cw",
}
ORACLES |= {
    "canonical_row_hashes": f"SELECT {_hash(FACT_COLUMNS)} AS row_hash FROM {_FACT}",
    "fact_bucket_digests": f"SELECT h[1:2] AS bucket, {_DIGEST} FROM (SELECT {_hash(FACT_COLUMNS)} AS h FROM {_FACT}) GROUP BY 1",
    "fact_evidence": f"SELECT '{_FACT}' AS relation, '{_types(FACT_COLUMNS[1:])}' AS schema, {_DIGEST} FROM (SELECT {_hash(FACT_COLUMNS[1:])} AS h FROM {_FACT})",
    "schedule_evidence": f"SELECT 'dim_tariff_band_schedule' AS relation, '{_types(SCHEDULE_COLUMNS[:-1])}' AS schema, {_DIGEST} FROM (SELECT {_hash(SCHEDULE_COLUMNS[:-1])} AS h FROM dim_tariff_band_schedule)",
    "series_digests": _judged(24)
    + f", s AS (SELECT household_id, {_DIGEST} FROM (SELECT household_id, {_hash(['source_date', 'kwh'])} AS h FROM judged WHERE unusable_reason IS NULL) GROUP BY 1), t AS (SELECT household_id, {_DIGEST} FROM (SELECT household_id, {_hash(['source_date'])} AS h FROM judged WHERE unusable_reason IS NULL) GROUP BY 1) SELECT household_id, s.row_count AS usable_days, s.digest AS series_digest, t.digest AS dates_digest FROM s JOIN t USING (household_id)",
    "fact_totals_by_household": f"SELECT household_id AS key, count(*) AS row_count, CAST(sum(consumption_kwh) AS VARCHAR) AS kwh, CAST(sum(energy_charge_gbp) AS VARCHAR) AS amount FROM {_FACT} GROUP BY 1",
    "fact_totals_by_month": f"SELECT source_month AS key, count(*) AS row_count, CAST(sum(consumption_kwh) AS VARCHAR) AS kwh, CAST(sum(energy_charge_gbp) AS VARCHAR) AS amount FROM {_FACT} GROUP BY 1",
    "fact_described": f"SELECT count(*) AS row_count, count(DISTINCT household_id) AS households, min(source_date) AS first_date, max(source_date) AS last_date, CAST(coalesce(sum(consumption_kwh), 0) AS VARCHAR) AS kwh, CAST(coalesce(sum(energy_charge_gbp), 0) AS VARCHAR) AS amount FROM {_FACT}",
    "fact_wrong_charges": f"SELECT DISTINCT household_id, source_timestamp_text, band_label, energy_charge_gbp, CAST(consumption_kwh * price_gbp_per_kwh AS DECIMAL(38,16)) AS expected_gbp FROM {_FACT} JOIN (SELECT tariff_group, band_label, price_gbp_per_kwh FROM dim_tariff_price) USING (tariff_group, band_label) WHERE energy_charge_gbp <> CAST(consumption_kwh * price_gbp_per_kwh AS DECIMAL(38,16))",
    "fact_copies_both_ways": f"WITH a AS (SELECT {', '.join(FACT_COLUMNS)} FROM {_FACT}), b AS (SELECT {', '.join(FACT_COLUMNS)} FROM fact_interval_charge_replica) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
    "fact_required_bands": f"SELECT *, 'missing' AS problem FROM (SELECT unnest(['Low', 'Normal', 'High']) AS band_label EXCEPT SELECT band_label FROM {_FACT}) UNION ALL SELECT *, 'unexpected' FROM (SELECT band_label FROM {_FACT} EXCEPT SELECT unnest(['Low', 'Normal', 'High']))",
    "archives_share_labels": f"SELECT household_id, source_timestamp_text FROM readings WHERE archive_name = '{BASE_ARCHIVE}' AND household_id IS NOT NULL AND source_timestamp_text IS NOT NULL INTERSECT SELECT household_id, source_timestamp_text FROM readings WHERE archive_name <> '{BASE_ARCHIVE}'",
    "fact_fk_violations": f"SELECT DISTINCT observed_at_naive AS key FROM {_FACT} WHERE observed_at_naive IS NOT NULL AND observed_at_naive NOT IN (SELECT schedule_label_naive FROM dim_tariff_band_schedule)",
    "fact_totals_by_band": f"SELECT band_label AS key, count(*) AS row_count, CAST(sum(consumption_kwh) AS VARCHAR) AS kwh, CAST(sum(energy_charge_gbp) AS VARCHAR) AS amount FROM {_FACT} GROUP BY 1",
    "fact_not_unique": f"SELECT household_id, source_timestamp_text, count(*) AS row_count FROM {_FACT} GROUP BY 1, 2 HAVING count(*) > 1",
    "fact_null_counts": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls FROM {_FACT}" for c in FACT_COLUMNS),
    "bands_not_accepted": f"SELECT band_label AS value, count(*) AS row_count FROM {_FACT} WHERE band_label NOT IN ('Low', 'Normal', 'High') GROUP BY 1",
    "fk_violations": "SELECT DISTINCT observed_at_naive AS key FROM readings WHERE observed_at_naive IS NOT NULL AND observed_at_naive NOT IN (SELECT schedule_label_naive FROM dim_tariff_band_schedule)",
    "accounting_membership": f"""WITH a AS (SELECT household_id, tariff_group, source_timestamp_text, consumption_raw_text FROM readings), b AS (SELECT f.household_id, f.tariff_group, f.source_timestamp_text, r.consumption_raw_text FROM {_FACT} f JOIN readings r ON r.household_id = f.household_id AND r.source_timestamp_text = f.source_timestamp_text)
 SELECT *, 'unaccounted' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
}


_zero_sql = """, z AS (SELECT household_id, source_date, source_date - CAST(row_number() OVER (PARTITION BY household_id ORDER BY source_date) AS INTEGER) AS k FROM judged WHERE unusable_reason IS NULL AND kwh = 0),
r AS (SELECT household_id, min(source_date) AS start, max(source_date) AS "end", count(*) AS days FROM z GROUP BY household_id, k), sp AS (SELECT household_id, min(source_date) AS lo, max(source_date) AS hi FROM judged GROUP BY 1),
st AS (SELECT household_id, source_date, coalesce('unusable:' || unusable_reason, 'nonzero_usable') AS state FROM judged),
o AS (SELECT r.*, CASE WHEN r.start - 1 < lo THEN 'recorded_span_edge' ELSE coalesce(b.state, 'absent') END AS before, CASE WHEN r."end" + 1 > hi THEN 'recorded_span_edge' ELSE coalesce(a.state, 'absent') END AS after FROM r JOIN sp USING (household_id) LEFT JOIN st b ON b.household_id = r.household_id AND b.source_date = r.start - 1 LEFT JOIN st a ON a.household_id = r.household_id AND a.source_date = r."end" + 1)
, zr AS (SELECT *, before = 'nonzero_usable' AND after = 'nonzero_usable' AS bounded, CASE WHEN days = 1 THEN '1' WHEN days <= 6 THEN '2-6' WHEN days <= 27 THEN '7-27' ELSE '28+' END AS bucket FROM o)
"""
_bucket_sql = ", ".join(f"count(*) FILTER (bucket = '{b}') AS runs_{b.replace('-', '_').replace('+', '_up')}" for b in ("1", "2-6", "7-27", "28+"))


def _scheduled_sql(intervals: int, zero_intervals: int, s: forecast.Schedule, sweep: tuple[int, ...]) -> dict[str, str]:
    """The SQL twins of ``_scheduled``."""
    origins = f""", fits AS (SELECT household_id, start AS run_start, "end" AS run_end, "end" - {s.holdout - 1} AS holdout_start FROM longest WHERE days >= {s.min_run}),
origins AS (
 SELECT household_id, run_start, run_end, 'development' AS split, CAST(unnest(generate_series(CAST(run_start + {s.warmup - 1} AS TIMESTAMP), CAST(holdout_start - {1 + s.horizon} AS TIMESTAMP), INTERVAL {s.step} DAY)) AS DATE) AS origin FROM fits
 UNION ALL SELECT household_id, run_start, run_end, 'holdout', CAST(unnest(generate_series(CAST(holdout_start - 1 AS TIMESTAMP), CAST(run_end - {s.horizon} AS TIMESTAMP), INTERVAL {s.step} DAY)) AS DATE) FROM fits)"""


    def wide(source: str, weeks: int, start: str | None, name: str = "wide") -> str:
        old = f"AND h.source_date >= c.{start}" if start else ""
        return f""", {name}_c AS (SELECT o.*, h.horizon, o.origin + CAST(h.horizon AS INTEGER) AS target_date FROM {source} o, (SELECT unnest(generate_series(1, {s.horizon})) AS horizon) h),
{name}_m AS (SELECT household_id, origin, horizon, avg(kwh) AS weekday_mean FROM (
 SELECT c.household_id, c.origin, c.horizon, h.kwh, row_number() OVER (PARTITION BY c.household_id, c.origin, c.horizon ORDER BY h.source_date DESC) AS rn FROM {name}_c c JOIN usable h ON h.household_id = c.household_id AND h.source_date <= c.origin {old} AND (c.target_date - h.source_date) % 7 = 0)
 WHERE rn <= {weeks} GROUP BY 1, 2, 3 HAVING count(*) = {weeks}),
{name} AS (SELECT c.*, a.kwh AS actual, CASE WHEN c.target_date - 7 <= c.origin THEN n.kwh END AS seasonal_naive, l.kwh AS last_day, m.weekday_mean FROM {name}_c c
 LEFT JOIN usable a ON a.household_id = c.household_id AND a.source_date = c.target_date LEFT JOIN usable n ON n.household_id = c.household_id AND n.source_date = c.target_date - 7
 LEFT JOIN usable l ON l.household_id = c.household_id AND l.source_date = c.origin LEFT JOIN {name}_m m ON m.household_id = c.household_id AND m.origin = c.origin AND m.horizon = c.horizon)"""


    cases = (
        _judged(intervals)
        + _RUNS
        + origins
        + wide("origins", s.weeks, "run_start")
        + """, long AS (SELECT *, CASE WHEN actual IS NULL THEN 'target_day_not_usable' WHEN predicted IS NULL THEN CASE model WHEN 'seasonal_naive' THEN CASE WHEN target_date - 7 > origin THEN 'lag_day_after_origin' ELSE 'lag_day_not_usable' END WHEN 'last_day' THEN 'origin_day_not_usable' ELSE 'insufficient_same_weekday_history' END END AS excluded_reason FROM (
 SELECT household_id, split, origin, horizon, target_date, actual, 'seasonal_naive' AS model, seasonal_naive AS predicted FROM wide UNION ALL SELECT household_id, split, origin, horizon, target_date, actual, 'last_day', last_day FROM wide UNION ALL SELECT household_id, split, origin, horizon, target_date, actual, 'weekday_mean', weekday_mean FROM wide)),
cases AS (SELECT *, CASE WHEN excluded_reason IS NULL THEN abs(predicted - actual) END AS abs_error FROM long)
"""
    )
    prior = (
        _judged(intervals)
        + _RUNS
        + f""", cal AS (SELECT CAST(unnest(generate_series(CAST(lo + {s.window - 1} AS TIMESTAMP), CAST(hi - {s.horizon} AS TIMESTAMP), INTERVAL {s.step} DAY)) AS DATE) AS origin FROM (SELECT min(source_date) AS lo, max(source_date) AS hi FROM judged)),
pc AS (SELECT h.household_id, cal.origin FROM (SELECT DISTINCT household_id FROM judged) h, cal)"""
        + wide("pc", s.weeks, None)
        + f""", seen AS (SELECT household_id, source_date AS origin, count(*) OVER (PARTITION BY household_id ORDER BY source_date RANGE BETWEEN INTERVAL {s.window - 1} DAY PRECEDING AND CURRENT ROW) AS in_window FROM usable),
prior AS (SELECT w.*, coalesce(CASE WHEN t.household_id IS NULL THEN 'absent' END, t.unusable_reason, 'scoreable') AS target_state, CASE WHEN s.in_window IS NULL THEN 'origin_day_not_usable' WHEN s.in_window < {s.min_usable} THEN 'thin_window' ELSE 'issued' END AS prediction_state
 FROM wide w LEFT JOIN seen s ON s.household_id = w.household_id AND s.origin = w.origin LEFT JOIN judged t ON t.household_id = w.household_id AND t.source_date = w.target_date)
"""
    )
    first = _WORDS[sweep[0]][0]
    made = {
        "usable_day_reasons": _judged(intervals) + "SELECT coalesce(unusable_reason, 'usable') AS reason, count(*) AS days FROM judged GROUP BY 1",
        "longest_usable_run": _judged(intervals) + _RUNS + "SELECT * FROM longest",
        "feasibility": _judged(intervals)
        + _RUNS
        + "SELECT (SELECT count(*) FROM judged) AS household_days, (SELECT count(*) FROM usable) AS usable_days, min(days) AS shortest_run, list_sort(list(days))[count(*) // 2 + 1] AS median_run, max(days) AS longest_run FROM longest",
        "zero_day_runs": _judged(zero_intervals) + _zero_sql + "SELECT * FROM zr",
        "zero_days_by_household": _judged(zero_intervals) + _zero_sql + "SELECT household_id, CAST(sum(days) AS BIGINT) AS zero_days, count(*) AS runs, count(*) FILTER (bounded) AS bounded_runs, max(days) AS longest_run, " + _bucket_sql + " FROM zr GROUP BY 1",
        "zero_days_summary": _judged(zero_intervals)
        + _zero_sql
        + "SELECT count(DISTINCT household_id) AS households, CAST(coalesce(sum(days), 0) AS BIGINT) AS zero_days, count(*) AS runs, count(*) FILTER (bounded) AS bounded_runs, "
        + _bucket_sql
        + ", max(days) AS longest_run, (SELECT household_id FROM zr ORDER BY days DESC, household_id DESC LIMIT 1) AS longest_household FROM zr",
        "forecast_origins": _judged(intervals) + _RUNS + origins + "SELECT * FROM origins",
        "forecast_predictions": cases + "SELECT household_id, split, origin, horizon, target_date, round(actual, 6) AS actual, model, round(predicted, 6) AS predicted, excluded_reason, round(abs_error, 6) AS abs_error FROM cases",
        "forecast_mae": cases + "SELECT split, model, horizon, count(*) AS scored, round(avg(abs_error), 6) AS mae, round(median(abs_error), 6) AS median_ae FROM cases WHERE abs_error IS NOT NULL GROUP BY 1, 2, 3",
        "forecast_common_frame": cases
        + "SELECT model, count(*) AS scored, round(avg(abs_error), 6) AS mae, round(median(abs_error), 6) AS median_ae FROM cases WHERE (household_id, origin, horizon) IN (SELECT (household_id, origin, horizon) FROM cases WHERE abs_error IS NOT NULL GROUP BY household_id, origin, horizon HAVING count(*) = 3) GROUP BY 1",
        "forecast_exclusions": cases + "SELECT split, model, coalesce(excluded_reason, 'scored') AS reason, count(*) AS cases FROM cases GROUP BY 1, 2, 3",
        "forecast_split_counts": cases + f"SELECT split, count(DISTINCT household_id) AS households, count(DISTINCT (household_id, origin)) AS origins, count(DISTINCT (household_id, target_date)) AS targets, count(DISTINCT (household_id, origin, horizon)) - count(DISTINCT (household_id, target_date)) AS repeated_targets, count(DISTINCT target_date) AS target_dates, max(seen) AS holdout_inputs FROM cases JOIN (SELECT split, count(*) FILTER (origin >= run_end - {s.holdout - 1}) AS seen FROM wide GROUP BY 1) USING (split) GROUP BY 1",
        "forecast_overlap": prior
        + origins
        + f", mine AS (SELECT DISTINCT household_id, origin, horizon FROM origins, (SELECT unnest(generate_series(1, {s.horizon})) AS horizon)) SELECT CASE WHEN m.household_id IS NULL THEN 'new' ELSE 'shared' END AS kind, count(*) AS cases FROM (SELECT DISTINCT household_id, origin, horizon FROM prior WHERE prediction_state = 'issued') p LEFT JOIN mine m USING (household_id, origin, horizon) GROUP BY 1",
        "cohort_composition": _judged(intervals)
        + _RUNS
        + origins
        + "SELECT groups, members, count(*) AS households FROM (SELECT household_id, array_to_string(list_sort(list(DISTINCT tariff_group)), ' | ') AS groups, count(DISTINCT member_name) AS members FROM readings WHERE household_id IN (SELECT household_id FROM origins) GROUP BY 1) GROUP BY 1, 2",
        "forecast_wide": cases + "SELECT household_id, origin, target_date, round(actual, 6) AS actual, round(seasonal_naive, 6) AS seasonal_naive, round(last_day, 6) AS last_day, round(weekday_mean, 6) AS weekday_mean FROM wide",
        "weeks_sweep": _judged(intervals)
        + _RUNS
        + origins
        + ", dev AS (SELECT * FROM origins WHERE split = 'development')"
        + "".join(wide("dev", k, "run_start", _WORDS[k]) for k in sweep)
        + f", u AS (SELECT {first}.actual, {', '.join(f'{_WORDS[k][0]}.weekday_mean AS p{k}' for k in sweep)} FROM {_WORDS[sweep[0]]} {first} {' '.join(f'JOIN {_WORDS[k]} {_WORDS[k][0]} USING (household_id, origin, horizon)' for k in sweep[1:])} WHERE {first}.actual IS NOT NULL AND {' AND '.join(f'{_WORDS[k][0]}.weekday_mean IS NOT NULL' for k in sweep)}) SELECT * FROM ("
        + " UNION ALL ".join(f"SELECT {k}, count(*), round(avg(abs(p{k} - actual)), 6) FROM u" if i else f"SELECT CAST({k} AS BIGINT) AS weeks, count(*) AS scored, round(avg(abs(p{k} - actual)), 6) AS mae FROM u" for i, k in enumerate(sweep))
        + ") WHERE scored > 0",
        "best_weeks": "",
        "first_eligible": _judged(intervals) + _RUNS + f"SELECT household_id, days FROM longest WHERE days >= {s.min_run} ORDER BY household_id LIMIT 40",
        "worst_days": cases + "SELECT household_id, origin, horizon, model, round(abs_error, 6) AS abs_error FROM cases WHERE abs_error IS NOT NULL ORDER BY round(abs_error, 6) DESC, household_id, origin, horizon, model LIMIT 10",
        "origin_calendar": _judged(intervals) + f"SELECT CAST(unnest(generate_series(CAST(lo + {s.window - 1} AS TIMESTAMP), CAST(hi - {s.horizon} AS TIMESTAMP), INTERVAL {s.step} DAY)) AS DATE) AS origin FROM (SELECT min(source_date) AS lo, max(source_date) AS hi FROM judged)",
        "prior_eligibility_cases": prior + "SELECT household_id, origin, horizon, target_date, target_state, prediction_state, CASE WHEN prediction_state = 'issued' THEN round(seasonal_naive, 6) END AS seasonal_naive, CASE WHEN prediction_state = 'issued' THEN round(last_day, 6) END AS last_day, CASE WHEN prediction_state = 'issued' THEN round(weekday_mean, 6) END AS weekday_mean FROM prior",
        "prior_report": prior
        + "SELECT model, count(*) AS scheduled, count(*) FILTER (prediction_state = 'issued') AS issued, count(*) FILTER (prediction_state = 'issued' AND predicted IS NULL) AS declined, count(*) FILTER (prediction_state = 'issued' AND target_state = 'scoreable') AS scoreable, count(*) FILTER (prediction_state = 'issued' AND target_state = 'scoreable' AND predicted IS NOT NULL) AS scored, round(avg(abs(predicted - actual)) FILTER (prediction_state = 'issued' AND target_state = 'scoreable'), 6) AS mae FROM (SELECT *, 'seasonal_naive' AS model, seasonal_naive AS predicted FROM prior UNION ALL SELECT *, 'last_day', last_day FROM prior UNION ALL SELECT *, 'weekday_mean', weekday_mean FROM prior) GROUP BY 1",
        "prior_coverage": prior + "SELECT prediction_state, target_state, count(*) AS cases FROM prior GROUP BY 1, 2",
    }
    made["best_weeks"] = f"SELECT weeks, mae FROM ({made['weeks_sweep']}) ORDER BY mae, weeks LIMIT 1"
    return made


ORACLES |= _scheduled_sql(*FULL) | {f"short_{name}": sql for name, sql in _scheduled_sql(*SHORT).items()}
