"""What columns a table must have, and whether one is ready to be read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from gridloom.sources.schedule import PRICES, SCHEDULE
from gridloom.sources.tables import table

# The contracts: columns in order with their types.
CONTRACTS = {
    "readings": "load_id string, archive_name string, member_name string, source_record_no bigint, household_id string, tariff_group string, source_timestamp_text string, observed_at_naive timestamp_ntz, timezone_status string, interval_anchor_status string, on_half_hour_grid boolean, consumption_kwh decimal(28,10), consumption_raw_text string, value_category string",
    "fact_interval_charge_scenario": "run_id string, household_id string, tariff_group string, source_timestamp_text string, observed_at_naive timestamp_ntz, source_date date, source_hour smallint, source_month smallint, band_label string, consumption_kwh decimal(28,10), price_pence_per_kwh decimal(9,4), energy_charge_gbp decimal(38,16), assumption_id string",
    "dim_tariff_band_schedule": SCHEDULE,
    "dim_tariff_price": PRICES,
}
STATUS = "relation string, column string, expected string, found string, status string"


def contract(name: str) -> dict[str, str]:
    """Columns and types of a relation."""
    return dict(c.split(" ", 1) for c in CONTRACTS[name].split(", "))


def staged(df: DataFrame, name: str) -> DataFrame:
    """The contract's columns in their order; a missing or differently typed one raises ``AnalysisException``."""
    found = dict(df.dtypes)
    wrong = [f"{c} {t}, found {found.get(c, 'nothing')}" for c, t in contract(name).items() if found.get(c) != t]
    if wrong:
        raise AnalysisException(f"{name} lacks {'; '.join(wrong)}")
    return df.select(*contract(name))


def schema_status(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """One row a column of each contract: ``ready``, ``absent`` (no table or no column) or ``incompatible`` (another type).

    Only schemas are read.
    """
    rows = []
    for name in names or CONTRACTS:
        try:
            found = dict(table(spark, folder, name).dtypes)
        except AnalysisException:
            found = {}
        for c, t in contract(name).items():
            rows.append((name, c, t, found.get(c), "ready" if found.get(c) == t else "incompatible" if c in found else "absent"))
    return spark.createDataFrame(rows, STATUS)


def availability(spark: SparkSession, folder: str, name: str) -> str:
    """The status of a whole relation: the worst of its columns."""
    seen = {r.status for r in schema_status(spark, folder, [name]).collect()}
    return next((s for s in ("incompatible", "absent") if s in seen), "ready")
