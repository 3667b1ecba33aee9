"""Mixed timestamp formats and time zones to one UTC instant (problem 7).

Texts are rewritten format by format into one field order inside the JVM. What the text leaves open
is estimated per load by counting violations: the order of day and month of numeric dates by dates
that would not exist, then by distance from neighbouring records in sequence; the clock of texts
without any zone by the history of offsets that ingestion times and sequence contradict least
(``clocks``). Then the labels are converted.
"""

from __future__ import annotations

import zoneinfo
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.binding import let
from gridloom.functions.text import WHITE, strip
from gridloom.functions.timeline import floor_div, from_micros, micros
from gridloom.operators.analytics import small
from gridloom.operators.clocks import clock_histories, covered
from gridloom.storage import materialize

HOUR_US = 3_600_000_000
LEAST_SUPPORT = 0.02
# European zone abbreviations and their offsets in hours.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "BST": 1, "IST": 1, "WEST": 1, "CET": 1, "MEZ": 1,
    "CEST": 2, "MESZ": 2, "EET": 2, "EEST": 3, "MSK": 3, "TRT": 3,
}
# The loader's zone statuses that name a clock.
STATUS_ZONES = {"utc": "UTC", "europe_london": "Europe/London"}
LOADER_FORMAT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}0$"
NUMERIC_DATE = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})(?!\d)"

_CLOCK = r"(\d{1,2})[:.-](\d{2})(?:[:.-](\d{2})(?:[.,](\d+))?)?(?: ?([AaPp])\.?[Mm]\.?)?"
_FORMATS = [
    # pattern, replacement to year|month|day|hour|minute|second|fraction|half of day
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})[Tt, ]+" + _CLOCK + "$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    (r"^(\d{4})(\d{2})(\d{2})[Tt, ]*(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?$", "$1|$2|$3|$4|$5|$6|$7|"),
    (r"^(?:\p{L}+\.?,? )?(\d{1,2})[ -](\p{L}+)\.?[ ,-]+(\d{4}),? " + _CLOCK + "$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (r"^" + _CLOCK + r",? (\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", "$6|$7|$8|$1|$2|$3|$4|$5"),
]
_NUMERIC = NUMERIC_DATE + r"[Tt, ]+" + _CLOCK + "$"


def _squeezed(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(col), f"{WHITE}+", " "), "[\u2010-\u2015\u2212]", "-")


def _zone_parts(t: Column) -> Column:
    """Struct of body, fixed_us and region of a squeezed text; nulls where it has none."""
    region = F.nullif(F.regexp_extract(t, r"\[?([A-Za-z]+(?:/[A-Za-z_+-]+[0-9]*)+)\]?$", 1), F.lit(""))
    region = let(region, lambda r: F.when(r.isin(sorted(z for z in zoneinfo.available_timezones() if "/" in z)), r))
    abbr = F.upper(F.regexp_extract(t, r"[0-9AaPpMm)] ?([A-Za-z]{2,4})$", 1))
    hours = F.try_element_at(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv]), abbr)
    signed = r"(?<=\d)(?:\.\d+)? ?(?:UTC|GMT)?([+-])(\d{2}):?(\d{2})$"
    # An offset follows a clock: a colon, or six digits after the date and a T or blank.
    has_offset = t.rlike(r"(?::\d{2}(?:[.,]\d+)?|[Tt ]\d{6}(?:[.,]\d+)?) ?(?:UTC|GMT)?[+-]\d{2}:?\d{2}$")
    sign = F.when(F.regexp_extract(t, signed, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    minutes = F.regexp_extract(t, signed, 2).try_cast("bigint") * 60 + F.regexp_extract(t, signed, 3).try_cast("bigint")
    return (
        F.when(t.rlike(r"\d ?[zZ]$"), F.struct(F.regexp_replace(t, " ?[zZ]$", "").alias("body"), F.lit(0).cast("bigint").alias("fixed_us"), F.lit(None).cast("string").alias("region")))
        .when(has_offset, F.struct(F.regexp_replace(t, r" ?(?:UTC|GMT)?[+-]\d{2}:?\d{2}$", "").alias("body"), (sign * minutes * 60_000_000).alias("fixed_us"), F.lit(None).cast("string").alias("region")))
        .otherwise(
            let(
                F.struct(region.alias("r"), hours.cast("bigint").alias("h")),
                lambda z: F.struct(
                    F.when(z["r"].isNotNull(), F.regexp_replace(t, r" ?\[?[A-Za-z]+(?:/[A-Za-z_+-]+[0-9]*)+\]?$", "")).when(z["h"].isNotNull(), F.regexp_replace(t, r" ?[A-Za-z]{2,4}$", "")).otherwise(t).alias("body"),
                    F.when(z["r"].isNull(), z["h"] * HOUR_US).alias("fixed_us"),
                    z["r"].alias("region"),
                ),
            )
        )
    )


def _month(m: Column) -> Column:
    names = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    by_name = F.nullif(F.array_position(F.array(*map(F.lit, names)), F.lower(F.substring(m, 1, 3))), F.lit(0))
    return F.coalesce(m.try_cast("int"), by_name.cast("int"))


def _wall_us(fields: Column) -> Column:
    """Microseconds of the wall clock written as year|month|day|hour|minute|second|fraction|half."""

    def numbers(p: Column) -> Column:
        hour = let(F.struct(p[3].try_cast("int").alias("h"), F.lower(p[7]).alias("half")), lambda x: F.when(x["half"] == "", x["h"]).when(x["h"].between(1, 12), x["h"] % 12 + F.when(x["half"] == "p", 12).otherwise(0)))
        year = let(p[0].try_cast("int"), lambda y: F.when(F.length(p[0]) == 2, y + 2000).otherwise(y))
        return F.struct(
            micros(F.try_make_timestamp_ntz(year, _month(p[1]), p[2].try_cast("int"), F.lit(0), F.lit(0), F.lit(0))).alias("day_us"),
            hour.cast("bigint").alias("h"),
            p[4].try_cast("bigint").alias("m"),
            F.when(p[5] == "", F.lit(0)).otherwise(p[5].try_cast("bigint")).alias("s"),
            F.rpad(F.substring(p[6], 1, 6), 6, "0").try_cast("bigint").alias("f"),
        )

    def sound(n: Column) -> Column:
        night = (n["h"] == 24) & (n["m"] == 0) & (n["s"] == 0) & (n["f"] == 0)
        return (n["h"].between(0, 23) | night) & n["m"].between(0, 59) & n["s"].between(0, 60)

    return let(F.split(fields, r"\|", -1), lambda p: F.when(F.size(p) == 8, let(numbers(p), lambda n: F.when(sound(n), n["day_us"] + n["h"] * HOUR_US + n["m"] * 60_000_000 + n["s"] * 1_000_000 + n["f"]))))


def _epoch_us(t: Column) -> Column:
    n = t.try_cast("decimal(20,0)")
    return (
        F.when(t.rlike(r"^\d{10}$"), (n * 1_000_000).cast("bigint"))
        .when(t.rlike(r"^\d{13}$"), (n * 1000).cast("bigint"))
        .when(t.rlike(r"^\d{16}$"), n.cast("bigint"))
        .when(t.rlike(r"^\d{19}$"), F.substring(t, 1, 16).try_cast("bigint"))
        .when(t.rlike(r"^\d{10}\.\d+$"), F.concat(F.substring(t, 1, 10), F.rpad(F.substring(t, 12, 6), 6, "0")).try_cast("bigint"))
    )


def _at_zone(wall: Column, zone: Column) -> Column:
    """Struct of us and odd ('ambiguous', 'nonexistent' or null) of a wall time on a zone's clock."""
    on_clock = lambda us: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))

    def judged(utc: Column) -> Column:
        twice = reduce(lambda a, b: a | b, [on_clock(utc + k * (HOUR_US // 2)) == wall for k in (-4, -2, -1, 1, 2, 4)])
        return F.struct(utc.alias("us"), F.when(on_clock(utc) != wall, "nonexistent").when(twice, "ambiguous").alias("odd"))

    return let(F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone)), judged)


def day_orders(readings: DataFrame, block: int = 50_000) -> DataFrame:
    """(load_id, day_first): the order of day and month each load's numeric dates keep.

    A date impossible under an order is a violation of it. Where both orders have as many, the
    order whose dates lie nearer to the label before them in the load's sequence wins; a load that
    leaves even this open counts as day first.
    """
    t = strip(F.col("source_timestamp_text"))
    a, b = F.regexp_extract(t, NUMERIC_DATE, 1).try_cast("int"), F.regexp_extract(t, NUMERIC_DATE, 2).try_cast("int")
    votes = (
        readings.select("load_id", "source_timestamp_text")
        .where(t.rlike(NUMERIC_DATE))
        .groupBy("load_id")
        .agg(F.count_if((b > 12) & (a <= 12)).alias("against_day"), F.count_if((a > 12) & (b <= 12)).alias("against_month"))
    )
    votes = materialize(votes, "dayvotes")  # one row a load that has numeric dates
    open_loads = votes.where(F.col("against_day") == F.col("against_month")).select("load_id")
    told = F.col("against_day") < F.col("against_month")
    if open_loads.isEmpty():
        return votes.select("load_id", told.alias("day_first"))
    y = F.regexp_extract(t, NUMERIC_DATE, 3).try_cast("int")
    y = F.when(y < 100, y + 2000).otherwise(y)
    day = lambda m, d: micros(F.try_make_timestamp_ntz(y, m, d, F.lit(0), F.lit(0), F.lit(0)))
    line = Window.partitionBy("load_id", "block").orderBy("source_record_no")
    near = (
        readings.select("load_id", "source_record_no", "source_timestamp_text", "observed_at_naive")
        .join(small(open_loads), "load_id", "left_semi")
        .withColumn("block", floor_div(F.col("source_record_no"), block))
        .withColumn("last_us", micros(F.last("observed_at_naive", ignorenulls=True).over(line)))
        .where(t.rlike(NUMERIC_DATE))
        .groupBy("load_id")
        .agg(F.sum((F.abs(day(b, a) - F.col("last_us"))).cast("double")).alias("far_day"), F.sum((F.abs(day(a, b) - F.col("last_us"))).cast("double")).alias("far_month"))
    )
    return votes.join(near, "load_id", "left").select(
        "load_id", F.when(F.col("against_day") != F.col("against_month"), told).otherwise(F.coalesce(F.col("far_day") <= F.col("far_month"), F.lit(True))).alias("day_first")
    )


def _label(text: Column, day_first: Column) -> Column:
    """Struct of epoch_us, fixed_us, region and wall_us, each null where the text lacks it."""
    numeric = {True: "$3|$2|$1|$4|$5|$6|$7|$8", False: "$3|$1|$2|$4|$5|$6|$7|$8"}

    def fields(body: Column) -> Column:
        first = F.when(body.rlike(_NUMERIC), F.when(day_first, F.regexp_replace(body, _NUMERIC, numeric[True])).otherwise(F.regexp_replace(body, _NUMERIC, numeric[False])))
        return reduce(lambda c, f: c.when(body.rlike(f[0]), F.regexp_replace(body, *f)), _FORMATS, first)

    return let(
        _squeezed(text),
        lambda t: let(
            _zone_parts(t),
            lambda z: F.struct(_epoch_us(t).alias("epoch_us"), z["fixed_us"].alias("fixed_us"), z["region"].alias("region"), let(z["body"], lambda b: _wall_us(fields(b))).alias("wall_us")),
        ),
    )


def parsed_labels(readings: DataFrame, only_known: bool = False) -> DataFrame:
    """Each reading's keys and its label as epoch_us, fixed_us, text_region, status_zone and wall_us.

    ``only_known`` keeps readings whose text or status tells the zone; the loader's plain format
    without a status is then dropped before any parsing. Each text is parsed once: the struct
    leaves a generator, past which no filter is pushed that would repeat the parsing.
    """
    status = reduce(lambda c, kv: c.when(F.col("timezone_status") == kv[0], F.lit(kv[1])), STATUS_ZONES.items(), F.when(F.lit(False), F.lit("")))
    base = readings.select("load_id", "source_record_no", "household_id", "source_timestamp_text", "interval_anchor_status", status.alias("status_zone"))
    text = F.col("source_timestamp_text")
    if only_known:
        base = base.where(F.col("status_zone").isNotNull() | ~text.rlike(LOADER_FORMAT))
    numeric = F.coalesce(strip(text).rlike(NUMERIC_DATE), F.lit(False))
    both = base.where(~numeric).withColumn("day_first", F.lit(True)).unionByName(base.where(numeric).join(small(day_orders(readings)), "load_id", "left").select(*base.columns, F.coalesce("day_first", F.lit(True)).alias("day_first")))
    told = lambda x: x["epoch_us"].isNotNull() | x["fixed_us"].isNotNull() | x["region"].isNotNull() | F.col("status_zone").isNotNull()
    label = F.array(_label(text, F.col("day_first")))
    return both.select(
        "load_id", "source_record_no", "household_id", "interval_anchor_status", "status_zone", F.inline(F.filter(label, told) if only_known else label)
    ).withColumnRenamed("region", "text_region")


def utc_instants(labels: DataFrame, clocks: DataFrame | None = None) -> DataFrame:
    """(source_record_no, instant_us, basis, problem) of parsed labels.

    basis is ``text``, ``status``, ``estimated`` (by ``clocks``, a history of clocks a load),
    ``assumed`` (nothing in the load tells the history's offset from others) or ``none``; problem is ``unreadable``,
    ``zone_unknown``, ``ambiguous``, ``nonexistent`` or null. Labels at an interval's end give the
    instant 30 minutes earlier. Null and empty texts are unreadable.
    """
    if clocks is None:
        x = labels.withColumns({"clock": F.lit(None).cast("string"), "support": F.lit(None).cast("double")})
    else:
        held = clocks.select(F.col("load_id").alias("_load"), "from_no", "to_no", "clock", "support")
        x = labels.join(held, (labels["load_id"] == F.col("_load")) & covered(labels["source_record_no"]), "left")
    x = x.withColumn("zone", F.when(F.col("epoch_us").isNull() & F.col("fixed_us").isNull(), F.coalesce("text_region", "status_zone", "clock")))
    text_known = F.col("epoch_us").isNotNull() | F.col("fixed_us").isNotNull() | F.col("text_region").isNotNull()
    basis = F.when(text_known, "text").when(F.col("status_zone").isNotNull(), "status").when(F.col("support") >= LEAST_SUPPORT, "estimated").when(F.col("clock").isNotNull(), "assumed").otherwise("none")
    shift = F.when(F.col("interval_anchor_status") == "interval_end", F.lit(HOUR_US // 2)).otherwise(F.lit(0))

    def made(x: Column) -> Column:
        problem = F.when(F.col("epoch_us").isNull() & F.col("wall_us").isNull(), "unreadable").when(x["basis"] == "none", "zone_unknown").otherwise(x["at"]["odd"])
        return let(problem, lambda p: F.struct(F.when(p.isNull(), F.coalesce(F.col("epoch_us"), F.col("wall_us") - F.col("fixed_us"), x["at"]["us"]) - shift).alias("instant_us"), x["basis"].alias("basis"), p.alias("problem")))

    # Daylight-saving checks run only where a zone's clock applies.
    at = F.when(F.col("zone").isNotNull() & F.col("wall_us").isNotNull(), _at_zone(F.col("wall_us"), F.col("zone")))
    return x.select("source_record_no", F.inline(F.array(let(F.struct(basis.alias("basis"), at.alias("at")), made))))


def iso_utc(us: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffffZ`` of UTC microseconds."""
    return F.date_format(from_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def known_instants(readings: DataFrame) -> DataFrame:
    """(source_record_no, instant_utc): every reading whose text or status tells its zone."""
    made = utc_instants(parsed_labels(readings, only_known=True))
    return made.where(F.coalesce(F.col("problem"), F.lit("")).isin("", "ambiguous", "nonexistent")).select(
        "source_record_no", F.coalesce("problem", iso_utc(F.col("instant_us"))).alias("instant_utc")
    )


def all_instants(readings: DataFrame, registry: DataFrame) -> DataFrame:
    """(source_record_no, instant_utc, basis, problem) of every reading, zones estimated where missing."""
    labels = materialize(parsed_labels(readings), "labels")
    return utc_instants(labels, clock_histories(labels, registry)).select("source_record_no", iso_utc(F.col("instant_us")).alias("instant_utc"), "basis", "problem")
