"""Instants against zoneinfo."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

from gridloom.operators import instants
from tests.helpers import reading, readings


def known(spark, cases):
    data = [reading(i, "HH1", None, 1, status=s, anchor=a, text=t, load=l) for i, (t, s, a, l) in enumerate(cases)]
    return {r.source_record_no: r.instant_utc for r in instants.known_instants(readings(spark, data)).collect()}


FIXED = [
    ("2014-01-05T02:30:00.000Z", "unresolved", "unresolved", "2014-01-05T02:30:00.000000Z"),
    ("2014-01-05T02:30:00z", "in_text", "interval_end", "2014-01-05T02:00:00.000000Z"),
    ("Fri, 01 May 2015 14:30:00 +0100", "in_text", "interval_start", "2015-05-01T13:30:00.000000Z"),
    ("1393399800", "in_text", "unresolved", "2014-02-26T07:30:00.000000Z"),
    ("1389296032000", "utc", "unresolved", "2014-01-09T19:33:52.000000Z"),
    ("1392015600250000", "in_text", "unresolved", "2014-02-10T07:00:00.250000Z"),
    ("20140105T110000Z", "in_text", "unresolved", "2014-01-05T11:00:00.000000Z"),
    ("20140108 173000", "europe_london", "unresolved", "2014-01-08T17:30:00.000000Z"),
    ("01 FEBRUARY 2015, 10:00:00 CET", "in_text", "unresolved", "2015-02-01T09:00:00.000000Z"),
    ("01-Feb-2015 09:30:00 BST", "in_text", "unresolved", "2015-02-01T08:30:00.000000Z"),
    ("2014-01-06T07:00:00.000001999Z", "in_text", "unresolved", "2014-01-06T07:00:00.000001Z"),
    ("2014-03-07 15:30:00[Europe/Paris]", "in_text", "unresolved", "2014-03-07T14:30:00.000000Z"),
    ("2014-07-07T15:30:00.500 Europe/Dublin", "in_text", "unresolved", "2014-07-07T14:30:00.500000Z"),
    ("2014-01-04 24:00", "utc", "unresolved", "2014-01-05T00:00:00.000000Z"),
    ("2014-01-04 24:00:01", "utc", "unresolved", None),
    ("2015-03-29 01:30:00.0000000", "europe_london", "unresolved", "nonexistent"),
    ("2015-10-25 01:30:00.0000000", "europe_london", "interval_end", "ambiguous"),
    ("2015-10-25 02:30:00 Europe/Paris", "utc", "unresolved", "ambiguous"),
    ("2015-10-25 02:30:00 CEST", "europe_london", "unresolved", "2015-10-25T00:30:00.000000Z"),
    ("2015-06-01 12:00:00.0000000", "unresolved", "unresolved", None),
    ("2015-06-01 12:00:00 Nowhere/Land", "unresolved", "unresolved", None),
    ("2014-03-29T19:00:00.000-0500", "europe_london", "unresolved", "2014-03-30T00:00:00.000000Z"),
    ("01/01/2016 05:30 AM", "utc", "unresolved", "2016-01-01T05:30:00.000000Z"),
    ("01/01/16 12:30 AM", "utc", "unresolved", "2016-01-01T00:30:00.000000Z"),
    ("", "utc", "unresolved", None),
    (None, "utc", "unresolved", None),
    ("x" * 50000, "utc", "unresolved", None),
]


def test_fixed_cases(spark):
    got = known(spark, [(t, s, a, f"l{i}") for i, (t, s, a, _) in enumerate(FIXED)])
    assert {i: got.get(i) for i in range(len(FIXED))} == {i: c[3] for i, c in enumerate(FIXED)}


def test_zones_match_zoneinfo_around_clock_changes(spark):
    rng = random.Random(3)
    cases, expect = [], {}
    for i in range(300):
        zone = rng.choice(["Europe/London", "Europe/Paris", "Europe/Athens"])
        day = rng.choice([dt.datetime(2015, 3, 29), dt.datetime(2015, 10, 25), dt.datetime(2016, 7, 1)])
        wall = day + dt.timedelta(minutes=rng.randrange(0, 360))
        cases.append((f"{wall.isoformat(sep=' ')} {zone}", "unresolved", "unresolved", "l"))
        first, second = (wall.replace(tzinfo=ZoneInfo(zone), fold=f) for f in (0, 1))
        utc = first.astimezone(dt.UTC)
        if utc.astimezone(ZoneInfo(zone)).replace(tzinfo=None) != wall:
            expect[i] = "nonexistent"
        elif first.utcoffset() != second.utcoffset():
            expect[i] = "ambiguous"
        else:
            expect[i] = utc.strftime("%Y-%m-%dT%H:%M:%S.000000Z")
    assert known(spark, cases) == expect


def test_day_order_is_one_for_a_load(spark):
    cases = [("13/02/2015 10:00", "utc", "unresolved", "d"), ("05/02/2015 10:00", "utc", "unresolved", "d"), ("02/13/15 10:00", "utc", "unresolved", "m"), ("02/05/15 10:00", "utc", "unresolved", "m")]
    got = known(spark, cases)
    assert [got[i][:10] for i in range(4)] == ["2015-02-13", "2015-02-05", "2015-02-13", "2015-02-05"]


def test_day_order_from_neighbours_in_sequence(spark):
    data = [
        reading(1, "HH1", "2015-03-04 10:00:00", 1, load="n"),
        reading(2, "HH1", None, 1, status="utc", text="03/04/2015 10:30", load="n"),
    ]
    got = {r.source_record_no: r.instant_utc for r in instants.known_instants(readings(spark, data)).collect()}
    assert got == {2: "2015-03-04T10:30:00.000000Z"}


def registry(spark, loads):
    return spark.createDataFrame(list(loads.items()), "load_id string, loaded_at_utc timestamp_ntz")


def on_clock(utc, zone):
    return utc.astimezone(ZoneInfo(zone)).replace(tzinfo=None)


def series(load, zone, start, n, first_no, households=("HH1", "HH2", "HH3"), status="unresolved"):
    """Half-hourly labels of a few households on a zone's clock, in order of time, with the true instants."""
    data, true = [], {}
    for i in range(n):
        utc = start + dt.timedelta(minutes=30 * i)
        for h in households:
            no = first_no + len(data)
            data.append(reading(no, h, None, 1, text=f"{on_clock(utc, zone).isoformat(sep=' ')}.0000000", load=load, status=status))
            true[no] = utc.strftime("%Y-%m-%dT%H:%M:%S.000000Z")
    return data, true


def estimated(spark, data, loads):
    return {r.source_record_no: r for r in instants.all_instants(readings(spark, data), registry(spark, loads)).collect()}


def test_missing_zones_are_told_by_clock_changes(spark):
    """Loads that run over a change of their clocks, long before they were ingested."""
    spring = {"Europe/London": 29, "Europe/Paris": 29, "America/New_York": 8}
    data, true = [], {}
    for k, (zone, day) in enumerate(spring.items()):
        more, own = series(f"l{k}", zone, dt.datetime(2015, 3, day - 1, tzinfo=dt.UTC), 120, 1 + 1000 * k)
        data, true = data + more, true | own
    got = estimated(spark, data, {f"l{k}": dt.datetime(2016, 1, 1) for k in range(3)})
    assert {no for no in true if got[no].instant_utc != true[no]} == set()
    # Other American clocks skip the same hour of the wall: New York is only the first named of them.
    assert {got[no].basis for no in true if no < 2000} == {"estimated"} and {got[no].basis for no in true if no >= 2000} == {"assumed"}


def test_missing_zones_are_told_by_the_lag_of_loads_with_known_zones(spark):
    """Loads of one day, ingested ninety minutes after their last label, as loads with zones are."""
    data, true, loads = [], {}, {}
    start = dt.datetime(2015, 1, 10, tzinfo=dt.UTC)
    for k in range(3):
        loads[f"known{k}"] = dt.datetime(2015, 1, 12)
        data.append(reading(1 + k, "HH9", None, 1, text="2015-01-11T22:30:00Z", load=f"known{k}", status="in_text"))
    for k, zone in enumerate(("Europe/Paris", "America/New_York", "UTC", "Asia/Kolkata")):
        more, own = series(f"l{k}", zone, start, 48, 1000 * (k + 1))
        data, true = data + more, true | own
        loads[f"l{k}"] = dt.datetime(2015, 1, 11, 1, 0)
    got = estimated(spark, data, loads)
    assert {no for no in true if got[no].instant_utc != true[no]} == set()


def test_a_load_that_changes_its_clock_half_way(spark):
    start = dt.datetime(2015, 1, 10, tzinfo=dt.UTC)
    first, true = series("l", "UTC", start, 1000, 1)
    second, more = series("l", "America/New_York", start + dt.timedelta(minutes=30 * 1000), 1000, 1 + len(first))
    last = start + dt.timedelta(minutes=30 * 1999)
    known = [reading(10_000_000, "HH9", None, 1, text="2015-01-11T22:30:00Z", load="known", status="in_text")]
    got = estimated(spark, first + second + known, {"l": (last + dt.timedelta(minutes=90)).replace(tzinfo=None), "known": dt.datetime(2015, 1, 12)})
    true |= more
    assert {no for no in true if got[no].instant_utc != true[no]} == set()


def test_changes_of_a_long_load_are_told_as_in_a_short_one(spark):
    """Two changes of clock, the load's last records millions of record numbers later."""
    start, last = dt.datetime(2015, 1, 10, tzinfo=dt.UTC), dt.datetime(2015, 1, 10, tzinfo=dt.UTC) + dt.timedelta(minutes=30 * 2399)
    data, true = [], {}
    for k, zone in enumerate(("Asia/Tokyo", "UTC", "America/New_York")):
        more, own = series("l", zone, start + dt.timedelta(minutes=30 * 800 * k), 800, 1 + len(data))
        data, true = data + more, true | own
    known = [reading(90_000_000, "HH9", None, 1, text="2015-01-11T22:30:00Z", load="known", status="in_text")]
    loads = {"l": (last + dt.timedelta(minutes=90)).replace(tzinfo=None), "known": dt.datetime(2015, 1, 12)}
    for far in (0, 20_000_000):
        moved = lambda no: no + far * (no > 7000)  # noqa: B023, E731
        got = estimated(spark, [(*r[:3], moved(r[3]), *r[4:]) for r in data] + known, loads)
        assert {no for no in true if got[moved(no)].instant_utc != true[no]} == set()


def test_nothing_tells_the_zone_of_a_late_load(spark):
    data, true = series("l", "Europe/Paris", dt.datetime(2015, 1, 10, tzinfo=dt.UTC), 48, 1)
    got = estimated(spark, data, {"l": dt.datetime(2016, 1, 1)})
    assert {r.basis for r in got.values()} == {"assumed"} and len(got) == len(true)
    assert {r.basis for r in estimated(spark, data, {}).values()} == {"assumed"}


def test_empty(spark):
    assert instants.known_instants(readings(spark, [])).count() == 0
