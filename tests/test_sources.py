"""Archives, repeatable loads and streams."""

import datetime as dt
import hashlib
import zipfile
from decimal import Decimal

from gridloom.sources import members, warehouse
from gridloom.streaming import ingest

GOOD = [["HH77", "Std", "2031-03-04 05:30:00.0000000", "  7.25"], ["HH77", "Std", "2031-03-04 06:00:00.0000000", "Null"], ["HH77", "Std", "2031-03-04 06:01:40.0000000", "8.5"]]
BAD = [["HH77", "Std", "never", "1"], ["HH77", "Std", "2031-03-04 06:00:00.0000000"], ["HH77", "Std", "2031-03-04 06:00:00.0000000", "0.98765432109"]]


def test_records_headers_and_broken_members(spark, tmp_path):
    members.write_archive(str(tmp_path / "a.zip"), {"x/one.csv": GOOD, "x/two.csv": [["a\nb", "c"]], "readme.txt": []})
    members.write_archive(str(tmp_path / "b.zip"), {"odd.csv": GOOD}, header=["LCLid"])
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("broken.csv", ",".join(members.HEADER) + '\r\na,b\r\n"x"y,c\r\nd,e\r\n')
        z.writestr("latin.csv", (",".join(members.HEADER) + "\r\né,b\r\n").encode("latin-1"))
        z.writestr("empty.csv", "")
    got = {(r.archive_name, r.member_name, r.source_record_no): r for r in members.read_records(spark, str(tmp_path)).collect()}
    assert [got["a.zip", "x/one.csv", i].fields for i in (1, 2, 3)] == GOOD
    assert got["a.zip", "x/two.csv", 1].fields == ["a\nb", "c"]
    assert got["b.zip", "odd.csv", 0].problem == "unexpected_header: expected 4 columns, found 1" and got["b.zip", "odd.csv", 3].complete
    assert got["c.zip", "broken.csv", 1].complete and not got["c.zip", "broken.csv", 2].complete
    assert ("c.zip", "broken.csv", 3) not in got
    assert not got["c.zip", "latin.csv", 1].complete
    assert got["c.zip", "empty.csv", 0].fields is None


def test_long_fields_and_headers_in_another_order(spark, tmp_path):
    long = "x" * 200_000
    members.write_archive(str(tmp_path / "a.zip"), {"long.csv": [["HH77", "Std", long, "1"]]})
    members.write_archive(str(tmp_path / "b.zip"), {"swapped.csv": GOOD}, header=members.HEADER[::-1])
    got = {(r.member_name, r.source_record_no): r for r in members.read_records(spark, str(tmp_path)).collect()}
    assert got["long.csv", 1].complete and got["long.csv", 1].fields[2] == long
    assert got["swapped.csv", 0].problem == "unexpected_header: columns in another order"
    loads = {r.member_name: r for r in warehouse.load(spark, str(tmp_path), str(tmp_path / "out")).collect()}
    assert (loads["swapped.csv"].status, loads["swapped.csv"].records_published) == ("failed", 0) and "another order" in loads["swapped.csv"].problem
    assert loads["long.csv"].status == "published"


def test_tallies(spark, tmp_path):
    data = b"a\r\nb\nc\rd\xe9"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m.csv", data)
    r = members.member_tallies(spark, str(tmp_path)).collect()[0]
    assert r.archive_sha256 == hashlib.sha256((tmp_path / "a.zip").read_bytes()).hexdigest() and r.compression == zipfile.ZIP_STORED and r.modified_at.year >= 1980
    assert (r.sha256, r.crlf, r.lf, r.lone_cr, r.non_ascii, r.ends_with_newline, r.physical_lines) == (hashlib.sha256(data).hexdigest(), 1, 1, 1, 1, False, 4)


def test_load_is_repeatable_and_replaces_members(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    members.write_archive(str(src / "a.zip"), {"one.csv": GOOD + BAD, "two.csv": GOOD})
    first = {r.member_name: (r.records_read, r.records_published, r.records_rejected) for r in warehouse.load(spark, str(src), root, dt.datetime(2020, 1, 1)).collect()}
    assert first == {"one.csv": (6, 3, 3), "two.csv": (3, 3, 0)}
    assert warehouse.load(spark, str(src), root).count() == 0
    r = warehouse.readings(spark, root)
    assert r.count() == 6 and {x.value_category for x in r.collect()} == {"finite_numeric", "null_token"}
    assert {x.consumption_kwh for x in r.collect()} == {Decimal("7.2500000000"), None, Decimal("8.5000000000")}
    assert r.where("not on_half_hour_grid").count() == 2
    members.write_archive(str(src / "a.zip"), {"one.csv": GOOD[:1], "two.csv": GOOD})
    assert [x.member_name for x in warehouse.load(spark, str(src), root, dt.datetime(2020, 1, 2)).collect()] == ["one.csv"]
    assert warehouse.readings(spark, root).count() == 4
    states = {(r.member_name, r.loaded_at_utc): (r.status, r.superseded_at_utc) for r in warehouse.registry(spark, root).collect()}
    assert states["one.csv", dt.datetime(2020, 1, 1)] == ("superseded", dt.datetime(2020, 1, 2)) and states["two.csv", dt.datetime(2020, 1, 1)] == ("published", None)
    assert warehouse.readings(spark, root, "rejected_records").count() == 0
    every = {x.reason for x in spark.read.parquet(f"{root}/rejected_records").collect()}
    assert every == {"invalid_timestamp", "wrong_field_count", "excessive_precision"}  # of the first load
    with zipfile.ZipFile(src / "b.zip", "w") as z:
        z.writestr("half.csv", ",".join(members.HEADER) + '\r\nHH77,Std,2031-03-04 05:30:00.0000000,1\r\n"x"y')
    failed = warehouse.load(spark, str(src), root, dt.datetime(2020, 1, 3)).collect()
    assert [(x.member_name, x.status, x.records_published) for x in failed] == [("half.csv", "failed", 0)]
    assert warehouse.readings(spark, root).count() == 4


def test_stream_of_raw_records(spark, tmp_path):
    rows = [(1, "H,S,2031-03-04 05:30:00.0000000,1"), (2, 'H,"S,x'), (3, "H"), (4, None)]
    for i in range(2):
        spark.createDataFrame(rows[i * 2 : i * 2 + 2], ingest.RAW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = ingest.to_tables(ingest.judged_stream(ingest.raw_stream(spark, str(tmp_path / "in"), 1)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    good = spark.read.parquet(str(tmp_path / "out/accepted"))
    bad = spark.read.parquet(str(tmp_path / "out/rejected"))
    assert [r.source_record_no for r in good.collect()] == [1]
    assert {r.source_record_no: r.reason for r in bad.collect()} == {2: "broken_quoting", 3: "wrong_field_count", 4: "broken_quoting"}


def test_stream_totals_count_repeats_once(spark, tmp_path):
    schema = "household_id string, instant timestamp, kwh decimal(28,10)"
    t = dt.datetime(2015, 1, 1, 10)
    spark.createDataFrame([("H", t, Decimal(1)), ("H", t, Decimal(1)), ("H", t + dt.timedelta(hours=1), Decimal(2)), ("H", t + dt.timedelta(days=3), Decimal(5))], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.windowed_totals(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("totals").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("totals").collect()
    assert [(r.household_id, float(r.kwh), r.readings) for r in got] == [("H", 3.0, 2)]


def test_stream_keeps_late_rows_apart(spark, tmp_path):
    schema = "household_id string, instant timestamp, kwh decimal(28,10)"
    t = dt.datetime(2015, 6, 1, 10)
    batches = [[("H", t, Decimal(1)), ("H", t, Decimal(1))], [("H", t + dt.timedelta(hours=1), Decimal(2)), ("H", t - dt.timedelta(days=90), Decimal(5))], [("H", t, Decimal(1))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        ingest.keep_all(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    totals = lambda late: {str(r.day): (float(r.kwh), r.readings) for r in ingest.kept_totals(spark, str(tmp_path / "out"), late).collect()}
    assert totals(True) == {"2015-06-01": (3.0, 2), "2015-03-03": (5.0, 1)} and totals(False) == {"2015-06-01": (3.0, 2)}


def test_bundles_are_deterministic_and_verified(spark, tmp_path):
    from gridloom.sources import bundles

    df = spark.createDataFrame([("b", Decimal("1.50"), None), ("a", Decimal("0E-10"), dt.date(2015, 1, 1))], "k string, v decimal(28,10), d date")
    rows = bundles.section(df, ["k"])
    assert rows[0] == {"k": "a", "v": "0.0000000000", "d": "2015-01-01"}
    first = bundles.write_bundle(str(tmp_path / "b"), {"one": rows, "none": []})
    assert first == bundles.write_bundle(str(tmp_path / "c"), {"none": [], "one": rows[:]}) and bundles.verify_bundle(str(tmp_path / "b")) == []
    (tmp_path / "b/one.json").write_text("[]")
    (tmp_path / "b/none.json").unlink()
    assert bundles.verify_bundle(str(tmp_path / "b")) == ["none: missing", "one: changed"]
    try:
        bundles.section(df, ["k"], most=1)
        raise AssertionError
    except ValueError:
        pass
