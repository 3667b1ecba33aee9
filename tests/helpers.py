"""Small builders of the meter tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

READINGS = (
    "load_id string, archive_name string, member_name string, source_record_no bigint, household_id string, tariff_group string, source_timestamp_text string, "
    "observed_at_naive timestamp_ntz, timezone_status string, interval_anchor_status string, on_half_hour_grid boolean, consumption_kwh decimal(28,10), consumption_raw_text string, value_category string"
)


def at(text):
    return dt.datetime.fromisoformat(text)


def reading(no, household, label, value, raw=None, status="unresolved", anchor="unresolved", text=None, member="m0", group="ToU", archive="a", load="load-1"):
    when = at(label) if label else None
    grid = None if when is None else when.minute in (0, 30) and when.second == 0 and when.microsecond == 0
    kwh = None if value is None else Decimal(str(value))
    text = text if text is not None else (f"{label}.0000000" if label else "?")
    return (load, archive, member, no, household, group, text, when, status, anchor, grid, kwh, raw if raw is not None else ("Null" if value is None else str(value)), "null_token" if value is None else "finite_numeric")


def readings(spark, rows):
    return spark.createDataFrame(rows, READINGS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
