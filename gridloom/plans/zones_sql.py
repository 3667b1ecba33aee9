"""Problem 7 written for DuckDB: the instants of readings whose zone is told."""

from __future__ import annotations

from gridloom.operators.instants import ABBREVIATIONS

_CLOCK = r"(\d{1,2})[:.-](\d{2})(?:[:.-](\d{2})(?:[.,](\d+))?)?(?: ?([AaPp])\.?[Mm]\.?)?"
_NUMBERS = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})"
# Each pattern with the groups it has, in order.
_SHAPES = [
    (_NUMBERS + r"[Tt, ]+" + _CLOCK + "$", "a b y h mi s f half"),
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})[Tt, ]+" + _CLOCK + "$", "y mo d h mi s f half"),
    (r"^(\d{4})(\d{2})(\d{2})[Tt, ]*(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?$", "y mo d h mi s f"),
    (r"^(?:\p{L}+\.?,? )?(\d{1,2})[ -](\p{L}+)\.?[ ,-]+(\d{4}),? " + _CLOCK + "$", "d mo y h mi s f half"),
    (r"^" + _CLOCK + r",? (\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", "h mi s f half y mo d"),
]


def _field(name: str) -> str:
    """A field of whichever shape the body has; numeric dates keep their load's order."""
    cases = []
    for pattern, groups in _SHAPES:
        names = groups.split()
        one = lambda g, p=pattern, n=names: f"regexp_extract(body, '{p}', {n.index(g) + 1})"
        if name in names:
            value = one(name)
        elif "a" in names and name in ("d", "mo"):
            value = f"CASE WHEN day_first = {'true' if name == 'd' else 'false'} THEN {one('a')} ELSE {one('b')} END"
        else:
            value = "''"
        cases.append(f"WHEN regexp_matches(body, '{pattern}') THEN {value}")
    return f"CASE {' '.join(cases)} END AS {name}"


_ABBR = "regexp_extract(t, '[0-9AaPpMm)] ?([A-Za-z]{2,4})$', 1)"
_OFFSET = r"(?::\d{2}(?:[.,]\d+)?|[Tt ]\d{6}(?:[.,]\d+)?) ?(?:UTC|GMT)?([+-])(\d{2}):?(\d{2})$"
_REGION = r"\[?([A-Za-z]+(?:/[A-Za-z_+-]+[0-9]*)+)\]?$"
_HOURS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in ABBREVIATIONS.items())
_VOTES = f"SELECT load_id, CAST(regexp_extract(t, '{_NUMBERS}', 1) AS INT) AS a, CAST(regexp_extract(t, '{_NUMBERS}', 2) AS INT) AS b FROM n WHERE regexp_matches(t, '{_NUMBERS}(?:[^0-9]|$)')"
P7_SQL = f"""WITH n AS (SELECT source_record_no, load_id, interval_anchor_status AS anchor, CASE timezone_status WHEN 'utc' THEN 'UTC' WHEN 'europe_london' THEN 'Europe/London' END AS clock,
 trim(regexp_replace(regexp_replace(source_timestamp_text, '[\\s\\p{{Z}}\\x{{85}}]+', ' ', 'g'), '[\\x{{2010}}-\\x{{2015}}\\x{{2212}}]', '-', 'g')) AS t FROM readings),
v AS (SELECT load_id, count(*) FILTER (b > 12 AND a <= 12) <= count(*) FILTER (a > 12 AND b <= 12) AS day_first FROM ({_VOTES}) GROUP BY 1),
p AS (SELECT n.*, coalesce(v.day_first, true) AS day_first, regexp_matches(t, '\\d ?[zZ]$') AS zulu, regexp_matches(t, '{_OFFSET}') AS offs, (SELECT any_value(name) FROM pg_timezone_names() g WHERE g.name = regexp_extract(n.t, '{_REGION}', 1) AND contains(name, '/')) AS region,
 CASE upper({_ABBR}) {_HOURS} END AS hours, CASE WHEN regexp_full_match(t, '\\d{{10}}') THEN CAST(t AS BIGINT) * 1000000 WHEN regexp_full_match(t, '\\d{{13}}') THEN CAST(t AS BIGINT) * 1000 WHEN regexp_full_match(t, '\\d{{16}}') THEN CAST(t AS BIGINT)
 WHEN regexp_full_match(t, '\\d{{19}}') THEN CAST(t[1:16] AS BIGINT) WHEN regexp_full_match(t, '\\d{{10}}\\.\\d+') THEN CAST(t[1:10] || rpad(t[12:17], 6, '0') AS BIGINT) END AS epoch FROM n LEFT JOIN v USING (load_id)),
b AS (SELECT *, CASE WHEN zulu THEN 0 WHEN offs THEN CAST(regexp_extract(t, '{_OFFSET}', 1) || '1' AS INT) * (CAST(regexp_extract(t, '{_OFFSET}', 2) AS INT) * 60 + CAST(regexp_extract(t, '{_OFFSET}', 3) AS INT)) WHEN region IS NULL THEN hours * 60 END AS minutes,
 CASE WHEN zulu THEN regexp_replace(t, ' ?[zZ]$', '') WHEN offs THEN regexp_replace(t, ' ?(?:UTC|GMT)?[+-]\\d{{2}}:?\\d{{2}}$', '') WHEN region IS NOT NULL THEN regexp_replace(t, ' ?{_REGION}', '') WHEN hours IS NOT NULL THEN regexp_replace(t, ' ?[A-Za-z]{{2,4}}$', '') ELSE t END AS body FROM p
 WHERE clock IS NOT NULL OR zulu OR offs OR region IS NOT NULL OR hours IS NOT NULL OR epoch IS NOT NULL),
f AS (SELECT *, {', '.join(map(_field, ['y', 'mo', 'd', 'h', 'mi', 's', 'f', 'half']))} FROM b),
c AS (SELECT *, try_cast((CASE WHEN length(y) = 2 THEN '20' || y ELSE y END) || '-' || coalesce(try_cast(mo AS INT), list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(mo[1:3]))) || '-' || d AS DATE) AS day,
 CASE WHEN coalesce(half, '') = '' THEN try_cast(h AS INT) WHEN try_cast(h AS INT) BETWEEN 1 AND 12 THEN try_cast(h AS INT) % 12 + CASE WHEN lower(half) = 'p' THEN 12 ELSE 0 END END AS hour, try_cast(mi AS INT) AS minute, coalesce(try_cast(nullif(s, '') AS INT), 0) AS second, CAST(rpad(coalesce(f, '')[1:6], 6, '0') AS INT) AS micro FROM f),
w AS (SELECT *, CASE WHEN (hour BETWEEN 0 AND 23 OR hour = 24 AND minute = 0 AND second = 0 AND micro = 0) AND minute BETWEEN 0 AND 59 AND second BETWEEN 0 AND 60 THEN CAST(day AS TIMESTAMP) + to_microseconds(((CAST(hour AS BIGINT) * 60 + minute) * 60 + second) * 1000000 + micro) END AS wall,
 CASE WHEN minutes IS NULL THEN coalesce(region, clock) END AS zone FROM c),
u AS (SELECT *, CASE WHEN zone IS NOT NULL AND wall IS NOT NULL AND epoch IS NULL THEN timezone(zone, wall) END AS at_zone FROM w),
o AS (SELECT source_record_no, anchor, CASE WHEN epoch IS NOT NULL THEN epoch WHEN minutes IS NOT NULL THEN epoch_us(wall) - CAST(minutes AS BIGINT) * 60000000 ELSE epoch_us(at_zone) END - CASE WHEN anchor = 'interval_end' THEN 1800000000 ELSE 0 END AS us,
 CASE WHEN at_zone IS NULL THEN NULL WHEN timezone(zone, at_zone) <> wall THEN 'nonexistent' WHEN timezone(zone, at_zone + INTERVAL 1 HOUR) = wall OR timezone(zone, at_zone - INTERVAL 1 HOUR) = wall THEN 'ambiguous' END AS odd FROM u)
SELECT source_record_no, coalesce(odd, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ')) AS instant_utc FROM o WHERE odd IS NOT NULL OR us IS NOT NULL"""
