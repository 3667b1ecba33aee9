"""Every query on hostile variants of the smallest tables: empty, and with null rows, repeats and clashing columns."""

import os
import sys

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import compare  # noqa: E402

from gridloom.plans import registry  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = ["readings", "rejected_records", "raw_records", "load_registry", "fact_interval_charge_scenario", "fact_interval_charge_replica", "dim_tariff_band_schedule", "dim_tariff_price"]
CLASHES = ["shard", "slot", "kwh", "at_us", "n", "sig", "day", "key", "value", "side", "chunk", "h1", "fields", "rank", "cell", "b", "m", "lo", "hi", "state", "run", "fit", "text", "copies"]
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def folder(tmp, change):
    for name in TABLES:
        pq.write_table(change(name, pq.read_table(f"{DATA}/{name}.parquet")), f"{tmp}/{name}.parquet")
    return str(tmp)


def hostile(name, t):
    nulls = pa.table({c: pa.nulls(2, t.schema.field(c).type) for c in t.column_names})
    if name == "dim_tariff_band_schedule":
        nulls = nulls.slice(0, 0)  # the schedule's labels are its key
    out = pa.concat_tables([t, t.slice(0, 3) if name.startswith(("readings", "fact")) else t.slice(0, 0), nulls.cast(t.schema)])
    for c in CLASHES:
        if c not in out.column_names:
            out = out.append_column(c, pc.cast(pa.array(["x"] * out.num_rows), pa.string()))
    return out


@pytest.fixture(scope="module")
def hostile_folder(tmp_path_factory):
    return folder(tmp_path_factory.mktemp("hostile"), hostile)


@pytest.fixture(scope="module")
def empty_folder(tmp_path_factory):
    return folder(tmp_path_factory.mktemp("empty"), lambda _, t: t.slice(0, 0))


def same(spark, folder_, name):
    import duckdb

    con = duckdb.connect()
    compare.views(con, folder_)
    df = registry.queries()[name](spark, folder_)
    mine, cols = compare.rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.oracle_sql():
        return
    cur = con.execute(registry.oracle_sql()[name])
    theirs, other = compare.rows([c[0] for c in cur.description], cur.fetchall())
    assert cols == other
    assert (mine - theirs, theirs - mine) == ({}, {})


NAMES = sorted(registry.queries())
SMALLER = {n.removeprefix("short_") for n in NAMES if n.startswith("short_")}  # these have rows here in their short form only


@needs_data
@pytest.mark.parametrize("name", [n for n in NAMES if n not in SMALLER])
def test_hostile_tables(spark, hostile_folder, name):
    same(spark, hostile_folder, name)


@needs_data
@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith("short_")])
def test_empty_tables(spark, empty_folder, name):
    same(spark, empty_folder, name)
