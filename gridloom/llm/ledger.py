"""Duplicates hidden by formatting differences, kept in an incremental ledger (problem 4).

A record's canonical key disregards white space, letter case, punctuation and the order of the
parts of each field. The ledger holds, in buckets by key, how many copies each key has had and its
earliest record. A new batch is aggregated map-side first, full-outer-joined with the buckets it
touches, and only those are written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.storage import listed, materialize, read_bytes, session_dir, write_bytes

LOADER_FORMAT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}0$"
SPACES = r"[\s\p{Z}\p{Cc}\p{Cf}]+"
DROPPED = r"[^\p{L}\p{M}\p{N}+~ ]"
COLUMNS = ["bucket", "h1", "h2", "copies", "first_no"]
SCHEMA = "bucket int, h1 bigint, h2 int, copies bigint, first_no bigint"


def _parts(text: Column, pattern: str) -> Column:
    return F.array_join(F.array_sort(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), " ")


def identifier_key(col: Column) -> Column:
    """Runs of letters and of digits in sorted order: ``HH0000042``, ``0000042/hh`` and ``HH 000.0042`` agree."""
    bare = F.regexp_replace(F.lower(col), r"[^\p{L}\p{M}\p{N}/ ]", "")
    return F.when(col.rlike("^HH[0-9]{7}$"), F.concat(F.substring(col, 3, 7), F.lit(" hh"))).otherwise(_parts(bare, r"\p{N}+|[\p{L}\p{M}]+"))


def label_key(col: Column) -> Column:
    """Parts of a timestamp text, punctuation dropped, sorted.

    Parts are parted by white space, by the ``T`` between date and time, and before the sign of an
    offset; that sign counts, other hyphens are punctuation.
    """
    text = F.regexp_replace(F.regexp_replace(F.lower(col), SPACES, " "), "[\u2010-\u2015\u2212]", "-")
    text = F.regexp_replace(text, r"(?<=[0-9])t(?=[0-9])", " ")
    text = F.regexp_replace(text, r"(:[0-9]{2}(?:[.,][0-9]+)?| [0-9]{6}(?:[.,][0-9]+)?) ?-([0-9]{2}:?[0-9]{2})$", "$1 ~$2")
    text = F.regexp_replace(text, r"(?<=[0-9]) ?\+(?=[0-9]{2}:?[0-9]{2}$)", " +")
    date, clock = F.translate(F.substring(col, 1, 10), "-", ""), F.translate(F.substring(col, 12, 16), ":.", "")
    return F.when(col.rlike(LOADER_FORMAT), F.concat(F.least(date, clock), F.lit(" "), F.greatest(date, clock))).otherwise(_parts(F.regexp_replace(text, DROPPED, ""), r"[^ ]+"))


def amount_key(col: Column) -> Column:
    """Numbers and words of a written value, sorted; sign, digits and decimal mark of a number count."""
    trimmed = F.trim(col)
    text = F.regexp_replace(F.lower(col), "[\u2010-\u2015\u2212]", "-")
    text = F.regexp_replace(text, "(?<=[0-9]),(?=[0-9])|(?<![0-9]),(?=[0-9])", ".")
    parts = _parts(text, r"[+-]?(?:[0-9]+(?:\.[0-9]+)*|\.[0-9]+)(?:e[+-]?[0-9]+)?|[\p{L}\p{M}]+|[\p{N}&&[^0-9]]+")
    words = F.regexp_replace(text, r"[^\p{L}\p{M}\p{N} ]", "")
    wordy = F.array_join(F.array_sort(F.split(F.trim(F.regexp_replace(words, SPACES, " ")), " ")), " ")
    return F.when(trimmed.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$"), trimmed).when(text.rlike("[0-9]"), parts).otherwise(wordy)


def keyed(records: DataFrame, fields: dict[str, str], record_no: str, *keep: str) -> DataFrame:
    """(record_no, keep..., h1, h2): each record with a 96-bit hash of its canonical key.

    ``fields`` maps columns to ``identifier``, ``label`` or ``amount``. A null field agrees with
    null only; an empty or wordless field agrees with other such fields.
    """
    rules = {"identifier": identifier_key, "label": label_key, "amount": amount_key}
    parts = [F.coalesce(rules[kind](F.col(c)), F.lit("\u0000")) for c, kind in fields.items()]
    return records.select(F.col(record_no).alias("record_no"), *keep, F.concat_ws("\u0001", *parts).alias("key")).select(
        "record_no", *keep, F.xxhash64("key").alias("h1"), F.hash("key").alias("h2")
    )


class CopyLedger:
    """Counts of canonical keys in buckets of files at a path, updated batch by batch, by any session.

    ``path/versions`` holds one small manifest a version, which names the folder each bucket lies
    in; ``path/data`` holds those folders. An update writes new folders for the buckets it touches
    and then, as one rename, the next manifest: readers see the ledger before or after, never in
    between, and of two writers at once the second fails. Buckets double when they have grown beyond
    ``keys_per_bucket`` keys on average, so a bucket stays a few hundred MB.
    """

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest
        self.buckets: int = manifest["buckets"]

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int = 16, keys_per_bucket: int = 20_000_000) -> CopyLedger:
        """The latest version of the ledger at ``path``, or an empty one."""
        names = [n for n in listed(spark, f"{path}/versions") if n.endswith(".json")]
        if names:
            return cls(spark, path, json.loads(read_bytes(spark, f"{path}/versions/{names[-1]}")))
        return cls(spark, path, {"version": 0, "buckets": buckets, "keys_per_bucket": keys_per_bucket, "keys": 0, "folders": {}})

    def entries(self, buckets: Iterable[int] | None = None, repeated: bool = False) -> DataFrame:
        """(bucket, h1, h2, copies, first_no) of the keys seen so far, in all or some buckets, or of ``repeated`` keys only.

        Buckets and the repeated keys are folders, so no file of the rest is read.
        """
        wanted = set(range(self.buckets) if buckets is None else buckets)
        folders: dict[str, list[int]] = {}
        for b, folder in self.manifest["folders"].items():
            if int(b) in wanted:
                folders.setdefault(folder, []).append(int(b))
        read = []
        for folder, own in sorted(folders.items()):
            t = self.spark.read.schema(f"{SCHEMA}, repeated boolean").parquet(f"{self.path}/data/{folder}").where(F.col("bucket").isin(own))
            read.append((t.where("repeated") if repeated else t).select(*COLUMNS))
        return reduce(DataFrame.unionByName, read) if read else self.spark.createDataFrame([], SCHEMA)

    def update(self, batch: DataFrame, small: bool = False) -> CopyLedger:
        """Add a batch of (record_no, h1, h2) rows and return the new version.

        The batch is aggregated map-side and full-outer-joined with the buckets it matches. A
        ``small`` batch first lists the buckets it touches, in a pass of its own, and leaves the
        files of all others alone; a large one touches them all.
        """
        buckets, per = self.buckets, self.manifest["keys_per_bucket"]
        while self.manifest["keys"] > buckets * per:
            buckets *= 2
        bucket = F.pmod("h1", F.lit(buckets)).cast("int").alias("bucket")
        new = batch.groupBy(bucket, "h1", "h2").agg(F.count("*").alias("n"), F.min("record_no").alias("no"))
        few = small and buckets == self.buckets
        touched = {r.bucket for r in batch.select(bucket).distinct().collect()} if few else set(range(buckets))
        if not touched:
            return self
        if self.manifest["folders"]:
            old = self.entries(touched if few else None).withColumn("bucket", bucket)
            merged = old.join(new, ["bucket", "h1", "h2"], "full_outer")
        else:
            merged = new.withColumns({"copies": F.lit(0), "first_no": F.lit(None).cast("bigint")})
        merged = merged.select(
            "h1",
            "h2",
            (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("bigint").alias("copies"),
            F.least("first_no", "no").alias("first_no"),
            "bucket",
        ).withColumn("repeated", F.col("copies") > 1)
        folder = uuid.uuid4().hex
        merged.write.partitionBy("bucket", "repeated").parquet(f"{self.path}/data/{folder}")
        version = self.manifest["version"] + 1
        kept = {b: f for b, f in self.manifest["folders"].items() if few and int(b) not in touched}
        manifest = {"version": version, "buckets": buckets, "keys_per_bucket": per, "keys": 0, "folders": kept | {str(b): folder for b in sorted(touched)}}
        made = CopyLedger(self.spark, self.path, manifest)
        manifest["keys"] = made.entries().count()  # from the files' footers
        if not write_bytes(self.spark, f"{self.path}/versions/{version:012d}.json", json.dumps(manifest, sort_keys=True).encode(), overwrite=False):
            raise RuntimeError(f"another writer has made version {version} of {self.path}")
        return made


def copy_pairs(rows: DataFrame, ledger: CopyLedger, hot_share: int = 100_000) -> DataFrame:
    """(kept_record_no, copy_record_no): the earliest record of each key with each further one.

    Keys holding more than one in ``hot_share`` rows number fewer than ``hot_share``: they are
    broadcast (24 bytes each), so no group is gathered in one task. The rest meet their rows by a
    shuffle join, each a hundred-thousandth of all rows at most, or 10,000 where that is more.
    """
    repeated = materialize(ledger.entries(repeated=True), "repeated")
    total = repeated.agg(F.sum("copies")).first()[0] or 0
    hot_from = max(10_000, total // hot_share)
    hot = repeated.where(F.col("copies") > hot_from).select("h1", "h2", F.col("first_no").alias("hot_no"))
    cold = repeated.where(F.col("copies") <= hot_from).select("h1", "h2", "first_no")
    marked = rows.join(F.broadcast(hot), ["h1", "h2"], "left")
    of_hot = marked.where(F.col("hot_no").isNotNull()).select(F.col("hot_no").alias("kept_record_no"), F.col("record_no").alias("copy_record_no"))
    of_cold = marked.where(F.col("hot_no").isNull()).select("h1", "h2", "record_no").join(cold, ["h1", "h2"]).select(F.col("first_no").alias("kept_record_no"), F.col("record_no").alias("copy_record_no"))
    return of_hot.unionByName(of_cold).where(F.col("kept_record_no") != F.col("copy_record_no"))


def ledger_of(spark: SparkSession, batches: Iterable[DataFrame], path: str | None = None, buckets: int = 16) -> CopyLedger:
    """A ledger grown by batches of keyed rows in turn; without a path it lives as long as the session."""
    ledger = CopyLedger.open(spark, path or f"{session_dir(spark)}/ledger-{uuid.uuid4().hex}", buckets)
    for batch in batches:
        ledger = ledger.update(batch)
    return ledger
