"""Reports on scopes, days and bands as queries over the meter tables, with their SQL twins."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from gridloom.operators import analytics, expansion, profile, review, terrain
from gridloom.plans import problems, reference
from gridloom.sources import contract
from gridloom.sources.tables import table
from gridloom.storage import session_dir
from gridloom.streaming import ingest

HOUSEHOLD, START, END = "HH0000042", dt.date(2015, 2, 1), dt.date(2015, 4, 30)
FACT, SCHEDULE = reference.FACT, "dim_tariff_band_schedule"


def _r(spark, d):
    return table(spark, d, "readings")


def _scope(spark, d):
    return review.scoped(_r(spark, d), HOUSEHOLD, START, END)


def _fact(spark, d):
    return table(spark, d, FACT)


def _checks(s, d):
    return terrain.checks(reference._cells(s, d), _fact(s, d), table(s, d, SCHEDULE))


def _streamed(spark, d):
    """The raw records read as a stream, judged, written and read again: the rejected ones with their reason."""
    root = f"{session_dir(spark)}/stream-{uuid.uuid4().hex}"
    raw = ingest.raw_stream(spark, f"{d}/raw_records.parquet*")
    ingest.to_tables(ingest.judged_stream(raw), root, f"{root}/checkpoint").awaitTermination()
    rejected = spark.read.schema(f"{ingest.RAW}, fields array<string>, reason string").option("recursiveFileLookup", "true").parquet(f"{root}/rejected*")
    return rejected.select("source_record_no", "reason")


QUERIES = {
    "stream_rejects": _streamed,
    "quality_record": lambda s, d: review.quality_record(_r(s, d)),
    "review_status": lambda s, d: review.review_status(review.quality_record(_r(s, d))),
    "day_report": lambda s, d: review.day_report(_r(s, d)),
    "scoped_quality": lambda s, d: review.quality_record(_scope(s, d)),
    "scoped_day_report": lambda s, d: review.day_report(_scope(s, d)),
    "scoped_band_summary": lambda s, d: analytics.band_summary(review.scoped(_fact(s, d), None, START, END)),
    "scoped_household_totals": lambda s, d: analytics.household_totals(review.scoped(_fact(s, d), None, START, END)),
    "demo_status": lambda s, d: review.is_demo(_r(s, d)),
    "conflict_rows": lambda s, d: review.conflict_rows(_r(s, d)),
    "repeat_examples": lambda s, d: review.repeat_examples(_r(s, d)),
    "conflicting_examples": lambda s, d: review.repeat_examples(_r(s, d), conflicting=True),
    "distinct_lists": lambda s, d: review.distinct_lists(_r(s, d), _fact(s, d)),
    "household_order": lambda s, d: review.household_order(analytics.household_totals(_fact(s, d))),
    "least_charged_households": lambda s, d: review.household_order(analytics.household_totals(_fact(s, d)), "row_count", 10),
    "band_display": lambda s, d: analytics.band_display(_fact(s, d)),
    "terrain_checks": _checks,
    "high_hours": lambda s, d: terrain.high_hours(table(s, d, SCHEDULE)),
    "interquartile_range": lambda s, d: profile.interquartile_range(_r(s, d)),
    "source_diff_removed_sources": lambda s, d: expansion.removed_sources(*reference._sets(s, d)),
    "source_diff_reasons": lambda s, d: expansion.reason_counts(*reference._sets(s, d)),
    "schema_status": contract.schema_status,
}

_SIG, _TEXT = reference._SIG, "household_id, tariff_group, source_timestamp_text, consumption_raw_text"
_GAPS = "SELECT household_id, CAST(t AS DATE) AS source_date FROM (SELECT household_id, t, lag(t) OVER (PARTITION BY household_id ORDER BY t) AS p FROM (SELECT DISTINCT household_id, observed_at_naive AS t FROM readings WHERE on_half_hour_grid AND observed_at_naive IS NOT NULL AND household_id IS NOT NULL)) WHERE date_diff('second', p, t) > 1800"
_LABELS = f"SELECT household_id, source_timestamp_text, count(*) AS n, coalesce(min({_SIG}) <> max({_SIG}), false) AS conflict, coalesce(min(consumption_raw_text) <> max(consumption_raw_text), false) AND NOT coalesce(min({_SIG}) <> max({_SIG}), false) AS eq FROM readings GROUP BY 1, 2"
_QUALITY = f"""WITH l AS ({_LABELS}), k AS (SELECT household_id, count(*) FILTER (n > 1) AS coll, count(*) FILTER (conflict) AS conf, count(*) FILTER (eq) AS eqs FROM l GROUP BY 1),
b AS (SELECT household_id, count(*) AS n, count(*) FILTER (value_category = 'finite_numeric') AS f, count(*) FILTER (value_category = 'null_token') AS nu, count(*) FILTER (consumption_kwh = 0) AS z, count(DISTINCT member_name) AS members FROM readings GROUP BY 1),
t AS (SELECT household_id, count(*) AS d FROM (SELECT DISTINCT {_TEXT} FROM readings) GROUP BY 1), g AS (SELECT household_id, count(*) AS gaps FROM ({_GAPS}) GROUP BY 1),
o AS (SELECT household_id, count(*) AS off FROM (SELECT DISTINCT household_id, source_timestamp_text, observed_at_naive, consumption_kwh FROM readings WHERE observed_at_naive IS NOT NULL AND NOT coalesce(on_half_hour_grid, false)) GROUP BY 1),
quality AS (SELECT b.household_id, b.n AS observed_records, t.d AS distinct_readings, b.n - t.d AS duplicates_removed, eqs AS equivalent_representations, f AS finite_values, nu AS null_tokens, b.n - f - nu AS other_non_numeric, z AS zero_values, coll AS candidate_key_collisions, conf AS conflicting_keys, conf + eqs AS repeated_timestamps, coalesce(gaps, 0) AS gaps, coalesce(off, 0) AS off_grid_observations, members
 FROM b LEFT JOIN t ON t.household_id IS NOT DISTINCT FROM b.household_id LEFT JOIN k ON k.household_id IS NOT DISTINCT FROM b.household_id LEFT JOIN g ON g.household_id IS NOT DISTINCT FROM b.household_id LEFT JOIN o ON o.household_id IS NOT DISTINCT FROM b.household_id) """
_DAY = (
    reference._DAILY_TOTALS
    + f""", gp AS (SELECT household_id, source_date, count(*) AS gaps_observed FROM ({_GAPS}) GROUP BY 1, 2),
ql AS (SELECT household_id, CAST(observed_at_naive AS DATE) AS source_date, source_timestamp_text, min({_SIG}) = max({_SIG}) AND min(consumption_raw_text) <> max(consumption_raw_text) AS eq, bool_or(coalesce(on_half_hour_grid, false) AND consumption_kwh IS NOT NULL) AS on_grid FROM readings WHERE observed_at_naive IS NOT NULL AND household_id IS NOT NULL GROUP BY 1, 2, 3),
qd AS (SELECT household_id, source_date, count(*) FILTER (eq) AS equivalent_representations, count(*) FILTER (on_grid) AS grid_readings FROM ql GROUP BY 1, 2)
SELECT d.*, coalesce(gaps_observed, 0) AS gaps_observed, coalesce(equivalent_representations, 0) AS equivalent_representations, CASE WHEN total_status = 'published' THEN coalesce(grid_readings, 0) ELSE 0 END AS contributing_readings,
 CASE WHEN has_conflict THEN 'conflicting readings' WHEN total_status = 'none' THEN CASE WHEN has_rows THEN 'for review' ELSE 'no readings recorded' END WHEN is_boundary_day THEN 'boundary date' WHEN missing_values > 0 OR coalesce(gaps_observed, 0) > 0 THEN 'for review' ELSE 'recorded' END AS status
 FROM daily d LEFT JOIN gp USING (household_id, source_date) LEFT JOIN qd USING (household_id, source_date)"""
)
_WITHIN = f"CAST(observed_at_naive AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'"


def _scoped(sql: str, relation: str, condition: str) -> str:
    """The same SQL on a part of a relation."""
    return sql.replace(f"FROM {relation}", f"FROM (SELECT * FROM {relation} WHERE {condition})")


_BAND = "SELECT band_label, sum(consumption_kwh) AS kwh, sum(energy_charge_gbp) AS amount, min(price_pence_per_kwh) AS least_pence, max(price_pence_per_kwh) AS greatest_pence FROM " + FACT + " GROUP BY 1"


def _percent(part: str, whole: str, scale: int, places: int) -> str:
    """part / whole in percent, rounded half up in whole numbers."""
    p, w = (f"CAST({c} * 1{'0' * scale}::HUGEINT AS HUGEINT)" for c in (part, whole))
    return f"CAST(CASE WHEN {whole} <> 0 THEN (2 * {p} * 1{'0' * (places + 2)} + {w}) // (2 * {w}) END AS DOUBLE) / 1{'0' * places}"


_REASONS = (
    reference._DIFF
    + f""", gone AS (SELECT b.* FROM b ANTI JOIN w USING (household_id, source_timestamp_text)), held AS (SELECT * FROM readings WHERE household_id IS NOT NULL AND source_timestamp_text IS NOT NULL),
now AS (SELECT household_id, source_timestamp_text, min({_SIG}) <> max({_SIG}) AS conflict FROM held GROUP BY 1, 2),
why AS (SELECT g.household_id, g.source_timestamp_text, g.kwh AS base_kwh, CASE WHEN conflict IS NULL THEN 'absent' WHEN conflict THEN 'conflict' ELSE 'no_number' END AS reason FROM gone g LEFT JOIN now USING (household_id, source_timestamp_text))
"""
)
_CHECK = lambda name, a, b: f"SELECT '{name}' AS \"check\", CAST({a} AS VARCHAR) AS \"left\", CAST({b} AS VARCHAR) AS \"right\", CAST({a} AS VARCHAR) = CAST({b} AS VARCHAR) AS holds FROM c, f"

ORACLES = {
    "stream_rejects": problems.ORACLES["p3_found"].replace(" UNION ALL SELECT source_record_no, source_fields FROM rejected_records WHERE reason IS NULL", ""),
    "quality_record": _QUALITY + "SELECT * FROM quality",
    "review_status": _QUALITY
    + """SELECT household_id, CASE WHEN conflicting_keys > 0 THEN 'blocking' WHEN null_tokens + gaps + conflicting_keys + off_grid_observations > 0 THEN 'review' ELSE 'clear' END AS level, null_tokens + gaps + conflicting_keys + off_grid_observations AS items,
 concat_ws(', ', CASE WHEN null_tokens > 0 THEN null_tokens || ' missing value(s)' END, CASE WHEN gaps > 0 THEN gaps || ' gap(s)' END, CASE WHEN conflicting_keys > 0 THEN conflicting_keys || ' conflicting timestamp(s)' END, CASE WHEN off_grid_observations > 0 THEN off_grid_observations || ' off-grid reading(s)' END) AS detail FROM quality""",
    "day_report": _DAY,
    "scoped_quality": _scoped(_QUALITY, "readings", f"household_id = '{HOUSEHOLD}' AND {_WITHIN}") + "SELECT * FROM quality",
    "scoped_day_report": _scoped(_DAY, "readings", f"household_id = '{HOUSEHOLD}' AND {_WITHIN}"),
    "scoped_band_summary": _scoped(reference._BANDS, FACT, _WITHIN),
    "scoped_household_totals": _scoped(reference.ORACLES["household_totals"], FACT, _WITHIN),
    "demo_status": "SELECT count(*) AS row_count, count(*) FILTER (household_id LIKE 'DEMO%') AS demo_rows, count(*) > 0 AND count(*) = count(*) FILTER (household_id LIKE 'DEMO%') AS all_demo FROM readings",
    "conflict_rows": f"SELECT r.household_id, r.source_timestamp_text, archive_name, member_name, source_record_no, consumption_raw_text, value_category, consumption_kwh FROM readings r JOIN {reference._CONF} c ON c.household_id = r.household_id AND c.source_timestamp_text = r.source_timestamp_text",
    "repeat_examples": "SELECT household_id, source_timestamp_text, count(*) AS row_count, min(source_record_no) AS first_record_no FROM readings WHERE household_id IS NOT NULL AND source_timestamp_text IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 3 DESC, 1, 2 LIMIT 5",
    "conflicting_examples": f"SELECT household_id, source_timestamp_text, count(*) AS row_count, min(source_record_no) AS first_record_no FROM readings WHERE household_id IS NOT NULL AND source_timestamp_text IS NOT NULL GROUP BY 1, 2 HAVING min({_SIG}) <> max({_SIG}) ORDER BY 3 DESC, 1, 2 LIMIT 5",
    "distinct_lists": f"SELECT DISTINCT 'households' AS list, household_id AS value FROM readings WHERE household_id IS NOT NULL UNION ALL SELECT DISTINCT 'tariff_groups', tariff_group FROM readings WHERE tariff_group IS NOT NULL UNION ALL SELECT DISTINCT 'charged_households', household_id FROM {FACT} WHERE household_id IS NOT NULL UNION ALL SELECT DISTINCT 'assumptions', assumption_id FROM {FACT} WHERE assumption_id IS NOT NULL",
    "household_order": reference.ORACLES["household_totals"] + " ORDER BY amount_gbp NULLS LAST, household_id",
    "least_charged_households": reference.ORACLES["household_totals"] + " ORDER BY row_count, household_id NULLS FIRST LIMIT 10",
    "band_display": f"""SELECT band_label, CASE band_label WHEN 'Low' THEN 1 WHEN 'Normal' THEN 2 WHEN 'High' THEN 3 ELSE 4 END AS place, CAST(kwh AS VARCHAR) AS kwh_exact, round(kwh, 3) AS kwh_display, CAST(amount AS VARCHAR) AS amount_exact, round(amount, 2) AS amount_display,
 {_percent('kwh', 'all_kwh', 10, 1)} AS kwh_percent, {_percent('amount', 'all_amount', 16, 1)} AS amount_percent, CAST(CASE WHEN kwh <> 0 THEN (2 * CAST(amount * 10000000000000000::HUGEINT AS HUGEINT) * 100000 + CAST(kwh * 10000000000::HUGEINT AS HUGEINT) * 1000000) // (2 * CAST(kwh * 10000000000::HUGEINT AS HUGEINT) * 1000000) END AS DOUBLE) / 1000 AS pence_per_kwh, least_pence, greatest_pence
 FROM (SELECT *, sum(kwh) OVER () AS all_kwh, sum(amount) OVER () AS all_amount FROM ({_BAND}))""",
    "terrain_checks": reference._CELLS
    + f""", c AS (SELECT CAST(coalesce(sum(row_count), 0) AS BIGINT) AS row_count, CAST(coalesce(sum(kwh), 0) AS DECIMAL(38,10)) AS kwh, CAST(coalesce(sum(amount_gbp), 0) AS DECIMAL(38,16)) AS amount, count(*) AS cells, count(DISTINCT source_date) * 48 AS expected, count(band_label) AS banded FROM cells),
f AS (SELECT count(*) AS n, CAST(coalesce(sum(consumption_kwh), 0) AS DECIMAL(38,10)) AS f_kwh, CAST(coalesce(sum(energy_charge_gbp), 0) AS DECIMAL(38,16)) AS f_amount, (SELECT count(*) FROM (SELECT DISTINCT CAST(schedule_label_naive AS DATE), hour(schedule_label_naive) * 2 + minute(schedule_label_naive) // 30 FROM dim_tariff_band_schedule WHERE band_label IS NOT NULL)) AS slots FROM {FACT} WHERE observed_at_naive IS NOT NULL)
"""
    + " UNION ALL ".join(_CHECK(*x) for x in (("rows", "row_count", "n"), ("kwh", "kwh", "f_kwh"), ("amount", "amount", "f_amount"), ("band_kwh", "kwh", "kwh"), ("band_amount", "amount", "amount"), ("month_rows", "row_count", "row_count"), ("month_kwh", "kwh", "kwh"), ("cells", "cells", "expected"), ("banded_slots", "banded", "slots"))),
    "high_hours": "WITH h AS (SELECT hour(schedule_label_naive) AS hour, count(*) AS n FROM dim_tariff_band_schedule WHERE band_label = 'High' GROUP BY 1), t AS (SELECT * FROM h WHERE n = (SELECT max(n) FROM h)) SELECT min(hour) AS from_hour, max(hour) AS to_hour, CAST(sum(n) AS BIGINT) AS slots, (SELECT CAST(sum(n) AS BIGINT) FROM h) AS total, CAST((2 * sum(n) * 1000 + (SELECT sum(n) FROM h)) // (2 * (SELECT sum(n) FROM h)) AS DOUBLE) / 10 AS percent, max(hour) - min(hour) + 1 = count(*) AS contiguous, (SELECT count(*) FROM h) = 24 AS every_hour FROM t HAVING count(*) > 0",
    "interquartile_range": f"SELECT q25, q75, CAST(q75 - q25 AS DECIMAL(38,10)) AS iqr FROM (SELECT max(value) FILTER (percent = 25) AS q25, max(value) FILTER (percent = 75) AS q75 FROM ({reference.ORACLES['nearest_rank_percentiles']})) WHERE q25 IS NOT NULL",
    "source_diff_removed_sources": _REASONS + "SELECT why.*, member_name, source_record_no, consumption_raw_text, value_category FROM why LEFT JOIN held USING (household_id, source_timestamp_text)",
    "source_diff_reasons": _REASONS
    + "SELECT kind, reason, count(*) AS labels, CAST(coalesce(sum(d), 0) AS DECIMAL(38,10)) AS kwh FROM (SELECT 'added' AS kind, 'settled' AS reason, w.kwh AS d FROM w ANTI JOIN b USING (household_id, source_timestamp_text) UNION ALL SELECT 'removed', reason, -base_kwh FROM why UNION ALL SELECT 'changed', 'value', w.kwh - b.kwh FROM w JOIN b USING (household_id, source_timestamp_text) WHERE w.kwh <> b.kwh) GROUP BY 1, 2",
    "schema_status": " UNION ALL ".join(f"SELECT '{n}' AS relation, '{c}' AS \"column\", '{t}' AS expected, '{t}' AS found, 'ready' AS status" for n in contract.CONTRACTS for c, t in contract.contract(n).items()),
}
