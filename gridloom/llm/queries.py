"""The problems tagged for training corpora as queries, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.llm import bpe, langid, ledger, mixing
from gridloom.sources.tables import table
from gridloom.storage import materialize

COPY_FIELDS = {"household_id": "identifier", "source_timestamp_text": "label", "consumption_raw_text": "amount"}


def _ledger(spark, d):
    """(rows, ledger) of all readings, keyed once and added to a ledger as two batches, half of the loads each."""
    readings = table(spark, d, "readings").withColumn("batch", F.pmod(F.xxhash64("load_id"), F.lit(2)).cast("int"))
    rows = materialize(ledger.keyed(readings, COPY_FIELDS, "source_record_no", "batch"), "copykeys", "batch")
    return rows, ledger.ledger_of(spark, [rows.where(F.col("batch") == b) for b in (0, 1)])


def p4_found(spark, d):
    rows, book = _ledger(spark, d)
    return ledger.copy_pairs(rows, book)


def p4_records(spark, d):
    return _ledger(spark, d)[1].entries().select(F.col("first_no").alias("kept_record_no"), "copies")


def p8_ids(spark, d):
    return bpe.token_ids(table(spark, d, "documents"), ["doc_id"])


def _counts(spark, d):
    return materialize(bpe.token_counts(table(spark, d, "documents"), ["doc_id", "source"]), "tokens")


def p8_counts(spark, d):
    return bpe.token_counts(table(spark, d, "documents"), ["doc_id"])


def p9_shares(spark, d):
    return mixing.shares(_counts(spark, d), table(spark, d, "mixture_targets"))


def p9_found(spark, d):
    return p9_shares(spark, d).where("is_short").select("mix_name", "source")


def p9_mixture(spark, d):
    return mixing.mixture(_counts(spark, d), table(spark, d, "mixture_targets"))


def p10_languages(spark, d):
    documents = table(spark, d, "documents")
    return langid.languages(documents, langid.fit_profiles(documents))


def p10_found(spark, d):
    return langid.wrong_labels(p10_languages(spark, d)).select("doc_id", "line_no", "lang")


QUERIES = {f.__name__: f for f in (p4_found, p4_records, p8_ids, p8_counts, p9_found, p9_shares, p9_mixture, p10_found, p10_languages)}
# The canonical key of a reading, written for DuckDB.
_KEY_SQL = r"""WITH folded AS (SELECT source_record_no, household_id AS h, consumption_raw_text AS v0, source_timestamp_text AS t0,
 regexp_replace(lower(household_id), '[^\p{L}\p{M}\p{N}/ ]', '', 'g') AS hh,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(source_timestamp_text), '[\s\p{Z}\p{Cc}\p{Cf}]+', ' ', 'g'), '[\x{2010}-\x{2015}\x{2212}]', '-', 'g'), '([0-9])t([0-9])', '\1 \2', 'g'),
  '(:[0-9]{2}(?:[.,][0-9]+)?| [0-9]{6}(?:[.,][0-9]+)?) ?-([0-9]{2}:?[0-9]{2})$', '\1 ~\2'), '([0-9]) ?\+([0-9]{2}:?[0-9]{2})$', '\1 +\2'), '[^\p{L}\p{M}\p{N}+~ ]', '', 'g') AS tt,
 regexp_replace(regexp_replace(lower(consumption_raw_text), '[\x{2010}-\x{2015}\x{2212}]', '-', 'g'), ',([0-9])', '.\1', 'g') AS vv FROM readings),
keyed AS (SELECT source_record_no, list_sort(regexp_extract_all(hh, '\p{N}+|[\p{L}\p{M}]+')) AS k1, list_sort(regexp_extract_all(tt, '[^ ]+')) AS k2,
 CASE WHEN regexp_matches(vv, '[0-9]') THEN list_sort(regexp_extract_all(vv, '[+-]?(?:[0-9]+(?:\.[0-9]+)*|\.[0-9]+)(?:e[+-]?[0-9]+)?|[\p{L}\p{M}]+')) ELSE list_sort(regexp_extract_all(regexp_replace(vv, '[^\p{L}\p{M}\p{N} ]', '', 'g'), '[^ ]+')) END AS k3 FROM folded),
ranked AS (SELECT source_record_no, min(source_record_no) OVER (PARTITION BY k1, k2, k3) AS kept, count(*) OVER (PARTITION BY k1, k2, k3) AS copies FROM keyed)
"""
ORACLES = {
    "p4_found": _KEY_SQL + "SELECT kept AS kept_record_no, source_record_no AS copy_record_no FROM ranked WHERE source_record_no <> kept",
    "p4_records": _KEY_SQL + "SELECT min(source_record_no) AS kept_record_no, count(*) AS copies FROM keyed GROUP BY k1, k2, k3",
}
