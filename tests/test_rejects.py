"""Failing records against a plain parser."""

import datetime as dt
import random
import re
from decimal import Decimal, InvalidOperation

from gridloom.operators import rejects


def plain_fields(s):
    out, i = [], 0
    while True:
        if s[i : i + 1] == '"':
            i, buf = i + 1, ""
            while True:
                if i >= len(s):
                    return None
                if s[i] == '"':
                    if s[i + 1 : i + 2] == '"':
                        buf, i = buf + '"', i + 2
                        continue
                    i += 1
                    break
                buf, i = buf + s[i], i + 1
            out.append(buf)
        else:
            j = i
            while j < len(s) and s[j] not in ',"\r\n':
                j += 1
            out.append(s[i:j])
            i = j
        if s[i : i + 1] == ",":
            i += 1
            continue
        return out if s[i:] in ("", "\n", "\r\n") else None


def plain_reason(s):
    if s is None:
        return "broken_quoting"
    f = plain_fields(s)
    if f is None:
        return "broken_quoting"
    if len(f) != 4:
        return "wrong_field_count"
    if not re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{6}0", f[2], re.A):
        return "invalid_timestamp"
    try:
        dt.datetime.strptime(f[2][:-1], "%Y-%m-%d %H:%M:%S.%f")
    except ValueError:
        return "invalid_timestamp"
    try:
        x = Decimal(f[3].strip())
    except InvalidOperation:
        return None
    if not x.is_finite():
        return None
    if -x.as_tuple().exponent > 10:
        return "excessive_precision"
    return "value_overflow" if abs(x) >= Decimal(10) ** 18 else None


CASES = [
    None, "", ",,,", 'HH1,"a,b",2015-01-01 00:00:00.0000000,1', 'HH1,"a""b\r\nc",2015-01-01 00:00:00.0000000,1\r\n', 'HH1,"a"x,2015-01-01 00:00:00.0000000,1', 'HH1,x"a",2015-01-01 00:00:00.0000000,1',
    'a,b,"2015-01-01 00:00:00.0000000" ,1', 'a,b,2015-02-29 00:00:00.0000000,1', "a,b,2016-02-29 00:00:00.0000000,1", "a,b,0000-01-01 00:00:00.0000000,1", "a,b,2015-01-01 24:00:00.0000000,1",
    "a,b,2015-01-01 00:00:00.0000001,1", " a,b, 2015-01-01 00:00:00.0000000,1", "a,b,2015-01-01 00:00:00.0000000,0.12345678901", "a,b,2015-01-01 00:00:00.0000000,1E-11", "a,b,2015-01-01 00:00:00.0000000,1E-10",
    "a,b,2015-01-01 00:00:00.0000000,1.00000000000E5", "a,b,2015-01-01 00:00:00.0000000,999999999999999999.9", "a,b,2015-01-01 00:00:00.0000000,1000000000000000000", "a,b,2015-01-01 00:00:00.0000000,-9.9e25",
    "a,b,2015-01-01 00:00:00.0000000,0e30", "a,b,2015-01-01 00:00:00.0000000,0E-20", "a,b,2015-01-01 00:00:00.0000000, Infinity ", "a,b,2015-01-01 00:00:00.0000000,n/a", "a,b,2015-01-01 00:00:00.0000000,\u2009.5\xa0",
    'a,b,2015-01-01 00:00:00.0000000,""', '""""', '"",,,', "a\nb", "a,b,2015-01-01 00:00:00.0000000,1e99999", "a,b,2015-01-01 00:00:00.0000000,1_000", "a\u0001,b,2015-01-01 00:00:00.0000000,\u0001e",
    '"' + 'x""' * 30000 + '",b,2015-01-01 00:00:00.0000000,1', "q" * 200000,
]


def run(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "source_record_no bigint, text string")
    return rejects.parsed_records(df, **kw)


def test_cases(spark):
    got = {r.source_record_no: r.reason for r in run(spark, CASES).collect()}
    assert got == {i: plain_reason(t) for i, t in enumerate(CASES)}


def test_cases_by_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr(rejects, "BROADCAST_ROWS", 0)
    got = {r.source_record_no: r.reason for r in run(spark, CASES, salts=3).collect()}
    assert got == {i: plain_reason(t) for i, t in enumerate(CASES)}


def test_random_texts(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(['"', '""', ",", "a", "\n", "1", "2015-01-01 00:00:00.0000000", ".5", "\r\n"]) for _ in range(rng.randrange(12))) for _ in range(600)]
    got = {r.source_record_no: (r.reason, r.fields) for r in run(spark, texts).collect()}
    assert {k: v[0] for k, v in got.items()} == {i: plain_reason(t) for i, t in enumerate(texts)}
    assert {k: v[1] for k, v in got.items()} == {i: plain_fields(t) for i, t in enumerate(texts)}


def test_hot_invalid_value_and_repeated_keys(spark):
    bad = "a,b,never,1"
    df = spark.createDataFrame([(1, bad)] * 300 + [(2, bad)] * 5 + [(None, bad)], "source_record_no bigint, text string")
    got = rejects.parsed_records(df).groupBy("source_record_no", "reason").count().collect()
    assert {(r[0], r[1], r[2]) for r in got} == {(1, "invalid_timestamp", 300), (2, "invalid_timestamp", 5), (None, "invalid_timestamp", 1)}


def test_sound_records_are_typed(spark):
    good = rejects.sound_records(run(spark, ["HH1,ToU,2015-01-01 00:30:00.1234560, .5 ", "HH1,ToU,2015-01-01 00:30:00.0000000,Null", "x"])).collect()
    assert sorted((str(r.observed_at_naive), r.consumption_kwh and float(r.consumption_kwh)) for r in good) == [("2015-01-01 00:30:00", None), ("2015-01-01 00:30:00.123456", 0.5)]


def test_empty(spark):
    assert run(spark, []).count() == 0
