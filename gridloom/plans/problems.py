"""The general data problems as queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import copies, instants, regular, rejects, rolling, spikes
from gridloom.operators.usable import usable_readings
from gridloom.plans.zones_sql import P7_SQL
from gridloom.sources.tables import table

FACT, REPLICA = "fact_interval_charge_scenario", "fact_interval_charge_replica"
FACT_KEYS = ["household_id", "source_timestamp_text"]
FACT_FIELDS = [
    "run_id", "tariff_group", "observed_at_naive", "source_date", "source_hour", "source_month", "band_label",
    "consumption_kwh", "price_pence_per_kwh", "energy_charge_gbp", "assumption_id",
]


def _usable(spark, d):
    return usable_readings(table(spark, d, "readings"))


def p1_differences(spark, d):
    found = copies.diff_copies(table(spark, d, FACT), table(spark, d, REPLICA), FACT_KEYS)
    named = F.replace(F.replace("difference", F.lit("missing_in_right"), F.lit("missing_in_replica")), F.lit("missing_in_left"), F.lit("missing_in_fact"))
    return found.select(*FACT_KEYS, named.alias("difference"), F.col("left_value").alias("fact_value"), F.col("right_value").alias("replica_value"), F.col("left_values").alias("fact_values"), F.col("right_values").alias("replica_values"))


def p1_found(spark, d):
    return p1_differences(spark, d).select(*FACT_KEYS, "difference")


def p2_found(spark, d):
    return rolling.silent_windows(rolling.daily_amounts(_usable(spark, d)))


def p2_rolling_totals(spark, d):
    return rolling.rolling_totals(rolling.daily_amounts(_usable(spark, d))).withColumn("average_kwh", F.round("average_kwh", 6))


def _parsed(spark, d):
    return rejects.parsed_records(rejects.unjudged_records(table(spark, d, "raw_records"), table(spark, d, "rejected_records")))


def p3_found(spark, d):
    return _parsed(spark, d).where(F.col("reason").isNotNull()).select("source_record_no", "reason")


def p3_details(spark, d):
    return _parsed(spark, d).where(F.col("reason").isNotNull()).select("source_record_no", "reason", "detail")


def p3_loaded(spark, d):
    return rejects.sound_records(_parsed(spark, d))


def p5_found(spark, d):
    return spikes.implausible_report(_usable(spark, d))


def p6_found(spark, d):
    return regular.gaps(regular.slot_values(_usable(spark, d)))


def p6_grid(spark, d):
    return regular.regular_grid(regular.slot_values(_usable(spark, d)))


def p7_found(spark, d):
    return instants.known_instants(table(spark, d, "readings"))


def p7_instants(spark, d):
    return instants.all_instants(table(spark, d, "readings"), table(spark, d, "load_registry"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_differences, p2_found, p2_rolling_totals, p3_found, p3_details, p3_loaded, p5_found, p6_found, p6_grid, p7_found, p7_instants)
}

# Canonical household id in SQL, for ids of HH and seven digits in any writing.
HOUSEHOLD_SQL = """CASE WHEN upper(regexp_replace(household_id, '[^A-Za-z]', '', 'g')) = 'HH' AND length(regexp_replace(household_id, '[^0-9]', '', 'g')) = 7
 THEN 'HH' || regexp_replace(household_id, '[^0-9]', '', 'g') ELSE nullif(upper(regexp_replace(household_id, '[^\\p{L}\\p{N}]', '', 'g')), '') END"""
USABLE_SQL = f"""usable AS (SELECT DISTINCT {HOUSEHOLD_SQL} AS household_id, observed_at_naive AS seen_at, consumption_kwh AS kwh FROM readings
 WHERE timezone_status = 'unresolved' AND observed_at_naive IS NOT NULL AND consumption_kwh IS NOT NULL AND household_id IS NOT NULL)"""
_DAYS_SQL = f"""WITH {USABLE_SQL},
daily AS (SELECT household_id, CAST(seen_at AS DATE) AS day, sum(kwh) AS kwh, count(*) AS n FROM usable WHERE household_id IS NOT NULL GROUP BY 1, 2),
span AS (SELECT household_id, min(day) AS lo, max(day) AS hi FROM daily GROUP BY 1),
calendar AS (SELECT household_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM span),
dense AS (SELECT c.household_id, c.day, coalesce(d.kwh, 0) AS kwh, coalesce(d.n, 0) AS n FROM calendar c LEFT JOIN daily d USING (household_id, day)),
rolled AS (
 SELECT household_id, day, 7 AS window_days, sum(kwh) OVER w7 AS kwh, sum(n) OVER w7 AS n FROM dense WINDOW w7 AS (PARTITION BY household_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
 UNION ALL
 SELECT household_id, day, 30, sum(kwh) OVER w30, sum(n) OVER w30 FROM dense WINDOW w30 AS (PARTITION BY household_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""
_SLOTS_SQL = f"""WITH {USABLE_SQL},
slots AS (SELECT household_id, time_bucket(INTERVAL 30 MINUTE, seen_at, TIMESTAMP '1970-01-01') AS slot, sum(kwh) AS kwh, count(*) AS n FROM usable WHERE household_id IS NOT NULL GROUP BY 1, 2)
"""


def _p1_sql() -> str:
    k = ", ".join(FACT_KEYS)
    both = f"(SELECT {k} FROM {FACT} INTERSECT SELECT {k} FROM {REPLICA})"
    parts = [f"SELECT {k}, 'missing_in_replica' AS difference FROM (SELECT {k} FROM {FACT} EXCEPT SELECT {k} FROM {REPLICA})", f"SELECT {k}, 'missing_in_fact' FROM (SELECT {k} FROM {REPLICA} EXCEPT SELECT {k} FROM {FACT})"]
    for c in FACT_FIELDS:
        one = lambda a, b: f"(SELECT {k}, {c} FROM {a} EXCEPT SELECT {k}, {c} FROM {b})"  # noqa: E731, B023
        parts.append(
            f"SELECT DISTINCT x.household_id, x.source_timestamp_text, '{c}' FROM (SELECT * FROM {one(FACT, REPLICA)} UNION ALL SELECT * FROM {one(REPLICA, FACT)}) x"
            f" JOIN {both} b ON x.household_id IS NOT DISTINCT FROM b.household_id AND x.source_timestamp_text IS NOT DISTINCT FROM b.source_timestamp_text"
        )
    return " UNION ALL ".join(parts)


def _p1_values_sql() -> str:
    """p1 with the smallest value, as text, that only one side has at a key, and how many such values there are."""
    k, same = ", ".join(FACT_KEYS), " AND ".join(f"x.{c} IS NOT DISTINCT FROM f.{c}" for c in FACT_KEYS)
    sides = []
    for c in FACT_FIELDS:
        for side, a, b in (("fact", FACT, REPLICA), ("replica", REPLICA, FACT)):
            sides.append(f"SELECT {k}, '{c}' AS difference, '{side}' AS side, CAST({c} AS VARCHAR) AS v FROM (SELECT {k}, {c} FROM {a} EXCEPT SELECT {k}, {c} FROM {b})")
    one = f"SELECT {k}, difference, min(v) FILTER (side = 'fact') AS fact_value, min(v) FILTER (side = 'replica') AS replica_value, count(*) FILTER (side = 'fact') AS fact_values, count(*) FILTER (side = 'replica') AS replica_values FROM ({' UNION ALL '.join(sides)}) GROUP BY ALL"
    return f"SELECT f.*, fact_value, replica_value, coalesce(fact_values, 0) AS fact_values, coalesce(replica_values, 0) AS replica_values FROM ({_p1_sql()}) f LEFT JOIN ({one}) x ON x.difference = f.difference AND {same}"


_FIELD = r'("(?:[^"]|"")*"|[^",\r\n]*)'
_BARE = "CASE WHEN {f} LIKE '\"%' THEN replace({f}[2:-2], '\"\"', '\"') ELSE {f} END"
_P3_SQL = f"""WITH texts AS (SELECT source_record_no, raw_text AS t FROM raw_records UNION ALL SELECT source_record_no, source_fields FROM rejected_records WHERE reason IS NULL),
cut AS (SELECT *, coalesce(regexp_full_match(t, '{_FIELD}(?:,{_FIELD})*(?:\\r?\\n)?'), false) AS quoted, coalesce(regexp_full_match(t, '{",".join([_FIELD] * 4)}(?:\\r?\\n)?'), false) AS four,
 regexp_extract(t, '^{",".join([_FIELD] * 4)}(?:\\r?\\n)?$', 1) AS f1, regexp_extract(t, '^{",".join([_FIELD] * 4)}(?:\\r?\\n)?$', 2) AS f2, regexp_extract(t, '^{",".join([_FIELD] * 4)}(?:\\r?\\n)?$', 3) AS f3, regexp_extract(t, '^{",".join([_FIELD] * 4)}(?:\\r?\\n)?$', 4) AS f4 FROM texts),
bare AS (SELECT *, {_BARE.format(f='f1')} AS bare1, {_BARE.format(f='f2')} AS bare2, {_BARE.format(f='f4')} AS bare4, CASE WHEN f3 LIKE '"%' THEN replace(f3[2:-2], '""', '"') ELSE f3 END AS stamp,
 regexp_replace(CASE WHEN f4 LIKE '"%' THEN replace(f4[2:-2], '""', '"') ELSE f4 END, '^[\\s\\x{{a0}}\\x{{2009}}]+|[\\s\\x{{a0}}\\x{{2009}}]+$', '', 'g') AS amount FROM cut),
num AS (SELECT *, regexp_full_match(amount, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') AS finite,
 coalesce(try_cast(nullif(regexp_extract(amount, '[eE]([+-]?[0-9]+)$', 1), '') AS INTEGER), 0) AS ex, regexp_extract(amount, '^[+-]?([0-9]*)', 1) AS ip, regexp_extract(amount, '^[+-]?[0-9]*\\.([0-9]*)', 1) AS fp FROM bare),
judged AS (SELECT *, length(regexp_replace(regexp_replace(t, '"(?:[^"]|"")*"', '', 'g'), '[^,]', '', 'g')) + 1 AS fields, CASE WHEN NOT quoted THEN 'broken_quoting' WHEN NOT four THEN 'wrong_field_count'
 WHEN NOT regexp_full_match(stamp, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}\\.[0-9]{{6}}0') OR stamp LIKE '0000%' OR stamp[12:13] > '23' OR try_cast(stamp[1:26] AS TIMESTAMP) IS NULL THEN 'invalid_timestamp'
 WHEN finite AND length(fp) - ex > 10 THEN 'excessive_precision' WHEN finite AND length(ltrim(ip || fp, '0')) > 0 AND length(ltrim(ip || fp, '0')) - (length(fp) - ex) > 18 THEN 'value_overflow' END AS reason FROM num)
"""
_P3_DETAIL = """SELECT source_record_no, reason, CASE reason WHEN 'broken_quoting' THEN CASE WHEN t IS NULL THEN 'no text' ELSE 'the text is no RFC 4180 record' END WHEN 'wrong_field_count' THEN 'expected 4 fields, found ' || fields
 WHEN 'invalid_timestamp' THEN 'third field is not YYYY-MM-DD HH:MM:SS.ffffff0 in the calendar' WHEN 'excessive_precision' THEN 'more than 10 decimals as written' ELSE 'size of 10^18 or more' END AS detail FROM judged WHERE reason IS NOT NULL"""
_P3_LOADED = """SELECT source_record_no, bare1 AS household_id, bare2 AS tariff_group, stamp AS source_timestamp_text, CAST(stamp[1:26] AS TIMESTAMP) AS observed_at_naive, CASE WHEN finite THEN CAST(amount AS DECIMAL(28,10)) END AS consumption_kwh, bare4 AS consumption_raw_text FROM judged WHERE reason IS NULL"""

# A spike stands above the lowest gap of a factor of three within the highest twentieth of a household's other readings.
_P5_SQL = f"""WITH {USABLE_SQL}, u AS (SELECT * FROM usable WHERE household_id IS NOT NULL), big AS (SELECT household_id FROM u GROUP BY 1 HAVING count(*) >= 20),
x AS (SELECT u.*, kwh < 0 OR kwh > 11.5 AS impossible, coalesce(kwh <> lag(kwh) OVER w, true)::INT AS new FROM u SEMI JOIN big USING (household_id) WINDOW w AS (PARTITION BY household_id ORDER BY seen_at, kwh)),
r AS (SELECT *, sum(new) OVER (PARTITION BY household_id ORDER BY seen_at, kwh) AS run FROM x), s AS (SELECT *, kwh <> 0 AND count(*) OVER (PARTITION BY household_id, run) >= 20 AS stuck FROM r),
o AS (SELECT *, lag(kwh) OVER (PARTITION BY household_id ORDER BY kwh) AS lower, percent_rank() OVER (PARTITION BY household_id ORDER BY kwh) AS place FROM s WHERE NOT impossible AND NOT stuck),
cut AS (SELECT household_id, min(kwh) AS from_kwh FROM o WHERE lower IS NOT NULL AND kwh >= 3 * lower AND kwh > 0 AND place >= 0.95 GROUP BY 1),
f AS (SELECT household_id, seen_at, 'impossible' AS kind FROM s WHERE impossible UNION SELECT household_id, seen_at, 'stuck' FROM s WHERE stuck UNION SELECT o.household_id, seen_at, 'spike' FROM o JOIN cut USING (household_id) WHERE kwh >= from_kwh)
SELECT household_id, strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS observed_at, kind FROM f"""

ORACLES = {
    "p1_found": _p1_sql(),
    "p2_found": _DAYS_SQL + "SELECT household_id, strftime(day, '%Y-%m-%d') AS reading_day, CAST(window_days AS BIGINT) AS window_days FROM rolled WHERE n = 0",
    "p2_rolling_totals": _DAYS_SQL + "SELECT household_id, day, CAST(window_days AS BIGINT) AS window_days, CAST(kwh AS DECIMAL(38,10)) AS total_kwh, round(CAST(kwh AS DOUBLE) / window_days, 6) AS average_kwh, CAST(n AS BIGINT) AS readings FROM rolled",
    "p1_differences": _p1_values_sql(),
    "p3_found": _P3_SQL + "SELECT source_record_no, reason FROM judged WHERE reason IS NOT NULL",
    "p3_details": _P3_SQL + _P3_DETAIL,
    "p3_loaded": _P3_SQL + _P3_LOADED,
    "p5_found": _P5_SQL,
    "p7_found": P7_SQL,
    "p6_found": _SLOTS_SQL
    + """SELECT household_id, strftime(before + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS gap_start, strftime(slot - INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS gap_end
 FROM (SELECT *, lag(slot) OVER (PARTITION BY household_id ORDER BY slot) AS before FROM slots) WHERE slot > before + INTERVAL 30 MINUTE""",
    "p6_grid": _SLOTS_SQL
    + """, span AS (SELECT household_id, min(slot) AS lo, max(slot) AS hi FROM slots GROUP BY 1), grid AS (SELECT household_id, unnest(generate_series(lo, hi, INTERVAL 30 MINUTE)) AS slot FROM span)
SELECT g.household_id, g.slot AS slot_start, CAST(s.kwh AS DECIMAL(38,10)) AS kwh, CAST(coalesce(s.n, 0) AS BIGINT) AS readings, s.n IS NULL AS is_missing FROM grid g LEFT JOIN slots s USING (household_id, slot)""",
}
