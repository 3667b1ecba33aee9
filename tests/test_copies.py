"""Diff of two copies against brute force."""

import random
from collections import defaultdict

from gridloom.operators.copies import diff_copies
from tests.helpers import rows

SCHEMA = "a string, b string, x decimal(10,4), y string, shard int"


def brute(left, right, keys=2, names=("x", "y", "shard")):
    out = set()
    by = [defaultdict(set), defaultdict(set)]
    for side, data in enumerate((left, right)):
        for r in data:
            by[side][r[:keys]].add(r[keys:])
    for k in by[0].keys() | by[1].keys():
        if k not in by[1]:
            out.add((*k, "missing_in_right"))
        elif k not in by[0]:
            out.add((*k, "missing_in_left"))
        elif by[0][k] != by[1][k]:
            hit = {n for i, n in enumerate(names) if {v[i] for v in by[0][k]} != {v[i] for v in by[1][k]}}
            hit = hit or {n for i, n in enumerate(names) if len({v[i] for v in by[0][k] | by[1][k]}) > 1}
            out |= {(*k, n) for n in hit}
    return out


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def run(spark, left, right, **kw):
    return {tuple(r)[:3] for r in diff_copies(table(spark, left), table(spark, right), ["a", "b"], **kw).collect()}


def test_random_copies(spark):
    from decimal import Decimal

    rng = random.Random(4)
    left = [(rng.choice(["h1", "H1", "h2", None, ""]), f"{rng.randrange(400):04d}", Decimal(rng.randrange(100)) / 8, rng.choice(["u", "v", None, ""]), rng.choice([1, None])) for _ in range(1500)]
    right = list(left)
    for i in rng.sample(range(len(right)), 60):
        r = list(right[i])
        r[rng.choice([2, 3, 4])] = None
        right[i] = tuple(r)
    right = [r for r in right if rng.random() > 0.03] + [("new", str(i), None, "u", 1) for i in range(5)] * 2
    rng.shuffle(right)
    expect = brute(left, right)
    assert expect
    for chunk, region in ((4, 200_000), (64, 200_000), (64, 50), (16, 1)):
        assert run(spark, left, right, chunk_rows=chunk, region_rows=region) == expect


def test_chunker_leaves_out_equal_chunks_over_many_batches():
    import numpy as np
    from gridloom.operators.copies import _Chunker

    rng = np.random.default_rng(1)
    key = np.arange(20_000)
    h1, h2 = rng.integers(-(2**62), 2**62, 20_000), rng.integers(-(2**31), 2**31, 20_000).astype(np.int32)
    gone, odd = set(rng.choice(20_000, 10, replace=False).tolist()), set(rng.choice(20_000, 10, replace=False).tolist())
    rows = [(k, s, h1[k] + (s if k in odd else 0), h2[k]) for k in key for s in (0, 1) if not (s and k in gone)]
    rows.sort(key=lambda r: (r[0], r[2], r[3], r[1]))
    for size in (len(rows), 997, 50):
        chunker, held, out = _Chunker(63, 200_000), [], []
        for at in range(0, len(rows), size):
            held += rows[at : at + size]
            k, s, a, b = map(np.array, zip(*held))
            lone, done = chunker.unmatched(s, a.astype(np.int64), b, final=at + size >= len(rows))
            out += [held[i] for i in lone]
            held = held[done:]
        assert not held
        found = {r[0] for r in out}
        assert gone | odd <= found and len(found) < 20 * 64 * 4


def test_equal_copies_in_another_order_with_repeats(spark):
    data = [("h", str(i), None, "x" * 1000, i) for i in range(300)]
    assert run(spark, data, data[::-1] + data[:50]) == set()


def test_one_key_holding_most_rows(spark):
    left = [("h", "t", None, str(i), 1) for i in range(500)] + [("h", "u", None, "", 1)]
    right = left[:-2] + [("h", "t", None, "other", 1)]
    assert run(spark, left, right) == {("h", "t", "y"), ("h", "u", "missing_in_right")}


def test_rows_that_differ_though_no_field_does(spark):
    left = [("h", "t", 1, "a", None), ("h", "t", 2, "b", None)]
    right = [("h", "t", 1, "b", None), ("h", "t", 2, "a", None)]
    from decimal import Decimal

    fix = lambda d: [(a, b, Decimal(x), y, z) for a, b, x, y, z in d]
    assert run(spark, fix(left), fix(right)) == {("h", "t", "x"), ("h", "t", "y")}


def test_empty_sides(spark):
    one = [("h", "t", None, None, None)]
    assert run(spark, [], []) == set()
    assert run(spark, one, []) == {("h", "t", "missing_in_right")}
    assert run(spark, [], one) == {("h", "t", "missing_in_left")}


def test_values_of_both_sides_are_reported(spark):
    d = diff_copies(table(spark, [("h", "t", None, "a", 1)]), table(spark, [("h", "t", None, None, 1)]), ["a", "b"])
    assert rows(d) == [("h", "t", "y", "a", None, 1, 1)]


def test_a_column_on_one_side_is_reported(spark):
    left = table(spark, [("h", "t", None, "a", 1)])
    found = diff_copies(left, left.drop("y").withColumn("z", left.x), ["a", "b"])
    assert rows(found.select("a", "b", "difference")) == [(None, None, "column_missing_in_left: z"), (None, None, "column_missing_in_right: y")]


def test_tables_of_keys_alone(spark):
    left, right = (spark.createDataFrame([(x, "t") for x in data], "a string, b string") for data in (["h", "i", "i"], ["h", "j"]))
    assert rows(diff_copies(left, right, ["a", "b"]).select("a", "b", "difference")) == [("i", "t", "missing_in_right"), ("j", "t", "missing_in_left")]


def test_decimals_of_another_scale_and_wider_integers_compare_by_value(spark):
    from decimal import Decimal

    left = table(spark, [("h", str(i), Decimal(i) / 8, "u", i) for i in range(40)])
    right = left.selectExpr("a", "b", "CAST(x AS decimal(20,6)) AS x", "y", "CAST(shard AS bigint) AS shard")
    assert rows(diff_copies(left, right, ["a", "b"])) == []
    changed = right.withColumn("x", right.x + Decimal("0.000001"))
    assert diff_copies(left, changed, ["a", "b"]).where("difference = 'x'").count() == 40
