"""The corpus queries on hostile and empty tables."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gridloom.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def folder(tmp, change):
    for name in ("readings", "documents", "mixture_targets"):
        pq.write_table(change(name, pq.read_table(f"{DATA}/{name}.parquet")), f"{tmp}/{name}.parquet")
    return str(tmp)


def hostile(_, t):
    nulls = pa.table({c: pa.nulls(2, t.schema.field(c).type) for c in t.column_names}).cast(t.schema)
    out = pa.concat_tables([t, t.slice(0, 3), nulls])
    for c in ("ids", "n_tokens", "key", "h1", "slot", "rank", "at", "label_code", "line_no", "copies", "drawn", "_text"):
        out = out.append_column(c, pa.array(["x"] * out.num_rows))
    return out


@pytest.fixture(scope="module")
def hostile_folder(tmp_path_factory):
    return folder(tmp_path_factory.mktemp("hostile"), hostile)


@pytest.fixture(scope="module")
def empty_folder(tmp_path_factory):
    return folder(tmp_path_factory.mktemp("empty"), lambda _, t: t.slice(0, 0))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_hostile(spark, hostile_folder, name):
    got = queries.QUERIES[name](spark, hostile_folder).collect()
    assert got
    if name in queries.ORACLES:
        import duckdb

        con = duckdb.connect()
        con.execute(f"CREATE VIEW readings AS SELECT * FROM '{hostile_folder}/readings.parquet'")
        cur = con.execute(queries.ORACLES[name])
        order = [c[0] for c in cur.description]
        assert sorted(map(repr, (tuple(r[c] for c in order) for r in got))) == sorted(map(repr, cur.fetchall()))
    if name == "p8_ids":
        assert [r.ids for r in got if r.doc_id is None] == [[], []]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty(spark, empty_folder, name):
    assert queries.QUERIES[name](spark, empty_folder).collect() == []
