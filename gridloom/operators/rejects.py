"""Rows that fail to parse, with their reason, beside the rows that load (problem 3).

Structure is judged on the text itself: split at its quotes, a sound RFC 4180 record has commas at
the right sides of every piece outside quotes. Values are judged once per distinct value and
column: the distinct third and fourth fields are cast, the failing ones form a dictionary of
invalid values with reasons, and the dictionary is joined back. Nothing is parsed row by row in
Python, and nothing recurses over long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.binding import let
from gridloom.functions.text import strip
from gridloom.storage import materialize

MAX_DECIMALS, MAX_DIGITS = 10, 18
BROADCAST_ROWS, BROADCAST_CHARS = 50_000, 8_000_000
# The loader's one timestamp format and the numbers a decimal text may be.
LOADER_FORMAT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}0$"
FINITE = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_ESC, _COMMA = "\u0001", "\u0001,"


def record_fields(text: Column) -> Column:
    """The fields of one RFC 4180 record as an array, null where the quoting is broken.

    One line end after the record is allowed, line ends inside quotes belong to the field. An
    empty text is one empty field; null gives null.
    """
    body = F.regexp_replace(text, r"\r?\n\z", "")

    def judged(pieces: Column) -> Column:
        n = F.size(pieces)

        def sound(piece: Column, i: Column) -> Column:
            left_ok = (i == 0) | (piece == "") | piece.startswith(",")
            right_ok = (i == n - 1) | (piece == "") | piece.endswith(",")
            lone = (n == 1) | ((i != 0) & (i != n - 1)) | (piece == "") | F.when(i == 0, piece.endswith(",")).otherwise(piece.startswith(","))
            return (i % 2 == 1) | (left_ok & right_ok & lone & ~F.contains(piece, F.lit("\n")) & ~F.contains(piece, F.lit("\r")))

        def marked(piece: Column, i: Column) -> Column:
            safe = F.replace(piece, F.lit(_ESC), F.lit(_ESC + "e"))
            outer = F.when((piece == "") & (i > 0) & (i < n - 1), F.lit('"')).otherwise(F.replace(safe, F.lit(","), F.lit(_COMMA)))
            return F.when(i % 2 == 1, safe).otherwise(outer)

        whole = F.array_join(F.transform(pieces, marked), "")
        fields = F.transform(F.split(whole, _COMMA, -1), lambda f: F.replace(f, F.lit(_ESC + "e"), F.lit(_ESC)))
        good = (n % 2 == 1) & F.forall(F.transform(pieces, lambda p, i: sound(p, i)), lambda ok: ok)
        return F.when(good, fields)

    return let(F.split(body, '"', -1), judged)


def _timestamp_reason(value: Column) -> Column:
    shaped = value.rlike(LOADER_FORMAT)
    real = F.substring(value, 1, 26).try_cast("timestamp_ntz").isNotNull() & (F.substring(value, 1, 4) != "0000")
    return F.when(~shaped | ~real, "invalid_timestamp")


def _number_reason(value: Column) -> Column:
    """Judge a finite number by its digits as written, the exponent counted; other texts pass."""
    text = F.replace(strip(value), F.lit("_"), F.lit(""))

    def judged(t: Column) -> Column:
        mantissa = F.regexp_replace(F.split(F.lower(t), "e", -1)[0], "^[+-]", "")
        exponent_text = F.regexp_extract(t, "[eE]([+-]?[0-9]+)$", 1)
        far = F.lit(10**9).cast("bigint")
        exponent = F.when(exponent_text == "", F.lit(0)).otherwise(F.coalesce(exponent_text.try_cast("bigint"), F.when(exponent_text.startswith("-"), -far).otherwise(far)))
        exponent = F.greatest(-far, F.least(far, exponent))
        decimals = F.length(F.regexp_extract(mantissa, r"\.([0-9]*)$", 1)) - exponent
        digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "^0+", "")
        # Digits before the decimal mark: all significant digits less those behind it.
        return (
            F.when(~t.rlike(FINITE), None)
            .when(decimals > MAX_DECIMALS, "excessive_precision")
            .when((digits != "") & (F.length(digits) - decimals > MAX_DIGITS), "value_overflow")
        )

    return let(text, judged)


DETAILS = {
    "broken_quoting": "the text is no RFC 4180 record",
    "invalid_timestamp": "third field is not YYYY-MM-DD HH:MM:SS.ffffff0 in the calendar",
    "excessive_precision": f"more than {MAX_DECIMALS} decimals as written",
    "value_overflow": f"size of 10^{MAX_DIGITS} or more",
}


def parsed_records(records: DataFrame, text: str = "text", key: str = "source_record_no", salts: int = 16) -> DataFrame:
    """(key, fields, reason, detail): every record with the first reason it fails for, or null.

    Reasons in order: broken_quoting, wrong_field_count, invalid_timestamp, excessive_precision,
    value_overflow. A null text is no record and fails as broken_quoting. The dictionary of
    invalid values is written once; its size is checked, and within ``BROADCAST_ROWS`` and
    ``BROADCAST_CHARS`` it is broadcast, so rows are not shuffled at all. Beyond that it is
    replicated over ``salts`` and rows are salted by their key, so a value that a third of all
    rows share is joined back by many tasks. Several rows of one key are each kept.
    """
    split = records.select(
        F.col(key).alias("key"), F.col(text).isNull().alias("absent"), F.inline(F.array(F.struct(record_fields(F.col(text)).alias("fields"))))
    )
    split = split.withColumns({"stamp": F.get("fields", F.lit(2)), "amount": F.get("fields", F.lit(3)), "salt": F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")})
    four = split.where(F.size("fields") == 4)
    cells = four.select(F.inline(F.array(F.struct(F.lit("stamp").alias("col"), F.col("stamp").alias("value")), F.struct(F.lit("amount").alias("col"), F.col("amount").alias("value"))))).distinct()
    invalid = cells.withColumn("why", F.when(F.col("col") == "stamp", _timestamp_reason(F.col("value"))).otherwise(_number_reason(F.col("value")))).where(F.col("why").isNotNull())
    invalid = materialize(invalid, "invalid")
    size = invalid.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("chars")).first()
    if size.n <= BROADCAST_ROWS and size.chars <= BROADCAST_CHARS:
        pick = lambda c: F.broadcast(invalid.where(F.col("col") == c).select(F.col("value").alias(c), F.col("why").alias(f"{c}_why")))
        judged = split.join(pick("stamp"), "stamp", "left").join(pick("amount"), "amount", "left")
    else:
        spread = invalid.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        pick = lambda c: spread.where(F.col("col") == c).select("salt", F.col("value").alias(c), F.col("why").alias(f"{c}_why"))
        judged = split.join(pick("stamp"), ["salt", "stamp"], "left").join(pick("amount"), ["salt", "amount"], "left")
    reason = (
        F.when(F.col("fields").isNull(), "broken_quoting").when(F.size("fields") != 4, "wrong_field_count").otherwise(F.coalesce("stamp_why", "amount_why"))
    )
    detail = (
        F.when(F.col("absent"), "no text")
        .when(reason == "wrong_field_count", F.concat(F.lit("expected 4 fields, found "), F.size("fields").cast("string")))
        .otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in DETAILS.items() for x in kv]), F.when(reason.isin(*DETAILS), reason)))
    )
    return judged.select(F.col("key").alias(key), "fields", reason.alias("reason"), detail.alias("detail"))


def unjudged_records(raw_records: DataFrame, rejected_records: DataFrame) -> DataFrame:
    """(source_record_no, text): raw texts, and the whole texts of records held back without reason."""
    return raw_records.select("source_record_no", F.col("raw_text").alias("text")).unionByName(
        rejected_records.where(F.col("reason").isNull()).select("source_record_no", F.col("source_fields").alias("text"))
    )


def sound_records(parsed: DataFrame) -> DataFrame:
    """The records that load, typed: a value that is no finite number is kept as a null consumption_kwh."""
    text = F.replace(strip(F.col("fields")[3]), F.lit("_"), F.lit(""))
    good = parsed.where(F.col("reason").isNull())
    return good.select(
        "source_record_no",
        F.col("fields")[0].alias("household_id"),
        F.col("fields")[1].alias("tariff_group"),
        F.col("fields")[2].alias("source_timestamp_text"),
        F.substring(F.col("fields")[2], 1, 26).try_cast("timestamp_ntz").alias("observed_at_naive"),
        F.when(text.rlike(FINITE), text).try_cast("decimal(28,10)").alias("consumption_kwh"),
        F.col("fields")[3].alias("consumption_raw_text"),
    )
