"""Reading CSV members of zip archives, with their identity and byte tallies.

A zip's members are not splittable, so each is one task that reads its own part of the archive and
parses it as a stream; record numbers come from the reader, since no later step could restore them.
"""

from __future__ import annotations

import csv
import datetime as dt
import hashlib
import io
import itertools
import sys
import urllib.parse
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.shipping import ship

# The header of a member, the blank at the end of the last name included.
HEADER = ["LCLid", "stdorToU", "DateTime", "KWH/hh (per half hour) "]
RECORDS = "archive_name string, member_name string, source_record_no bigint, fields array<string>, complete boolean, problem string"
TALLY = "archive_name string, member_name string, byte_count bigint, sha256 string, lf bigint, crlf bigint, lone_cr bigint, non_ascii bigint, ends_with_newline boolean, physical_lines bigint, crc32 bigint, compressed_bytes bigint, modified_at timestamp_ntz, compression bigint, archive_sha256 string"
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}
TALLY_ARROW = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in TALLY.split(", ")])
BATCH = 20_000


def _members(spark: SparkSession, path: str) -> DataFrame:
    """(archive_name, path, member_name): one row a CSV member, from the zip directories alone."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path")
    schema = pa.schema([("archive_name", pa.string()), ("path", pa.string()), ("member_name", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where in batch.column(0).to_pylist():
                with _opened(where) as file, zipfile.ZipFile(file) as z:
                    names = [i.filename for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith(".csv")]
                rows = [{"archive_name": where.rsplit("/", 1)[-1], "path": where, "member_name": n} for n in names]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, "archive_name string, path string, member_name string").repartition("path", "member_name")


def _opened(path: str) -> BinaryIO:
    """A seekable file of a path that Spark lists: a shared folder's, or through pyarrow any other file system's."""
    if "://" not in path:
        return open(urllib.parse.unquote(path.removeprefix("file:")), "rb")
    if path.startswith("file://"):
        return open(urllib.parse.unquote(urllib.parse.urlparse(path).path), "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def header_problem(header: list[str] | None) -> str | None:
    """What differs between a header and the contract's, or null."""
    if header == HEADER:
        return None
    if not header:
        return "no header"
    if len(header) != len(HEADER):
        return f"expected {len(HEADER)} columns, found {len(header)}"
    if sorted(header) == sorted(HEADER):
        return "columns in another order"
    return "unexpected names: " + " | ".join(h for h, want in zip(header, HEADER) if h != want)


def _parse(archive: str, info: zipfile.ZipInfo, z: zipfile.ZipFile) -> Iterator[tuple]:
    """Records numbered from 1 after the header; a parser error ends the member, marked incomplete."""
    csv.field_size_limit(sys.maxsize)  # a field may be as long as it is
    no = 0
    try:
        with z.open(info) as raw:
            reader = csv.reader(io.TextIOWrapper(raw, "ascii", newline=""), strict=True)
            header = next(reader, None)
            if header_problem(header):
                yield archive, info.filename, 0, header, False, f"unexpected_header: {header_problem(header)}"
            for no, fields in enumerate(reader, 1):
                yield archive, info.filename, no, fields, True, None
    except (csv.Error, UnicodeDecodeError, zipfile.BadZipFile) as e:
        yield archive, info.filename, no + 1, None, False, f"{type(e).__name__}: {e}"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of every CSV member of the zip archives under a folder.

    A header that is not the contract's gives a row with number 0 and ``complete`` false; a member
    that cannot be read to its end gives a last row with ``complete`` false. Archives without CSV
    members give no rows. Each member is a task of its own and is parsed as a stream.
    """
    schema = pa.schema([("archive_name", pa.string()), ("member_name", pa.string()), ("source_record_no", pa.int64()), ("fields", pa.list_(pa.string())), ("complete", pa.bool_()), ("problem", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row["path"]) as file, zipfile.ZipFile(file) as z:
                    records = _parse(row["archive_name"], z.getinfo(row["member_name"]), z)
                    while held := list(itertools.islice(records, BATCH)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    return _members(spark, path).mapInArrow(run, RECORDS)


def member_tallies(spark: SparkSession, path: str) -> DataFrame:
    """Identity of each member: SHA-256 of its bytes and of its archive, line ends by kind, directory facts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                digest, n, lf, cr, crlf, high, last = hashlib.sha256(), 0, 0, 0, 0, 0, b""
                with _opened(row["path"]) as file:
                    archive = hashlib.sha256()
                    while block := file.read(1 << 20):
                        archive.update(block)
                with _opened(row["path"]) as file, zipfile.ZipFile(file) as z:
                    info = z.getinfo(row["member_name"])
                    with z.open(info) as raw:
                        while block := raw.read(1 << 20):
                            digest.update(block)
                            n += len(block)
                            lf += block.count(b"\n")
                            cr += block.count(b"\r")
                            crlf += block.count(b"\r\n") + (last == b"\r" and block[:1] == b"\n")
                            high += len(block.translate(None, bytes(range(128))))
                            last = block[-1:]
                ended = last in (b"\n", b"\r")
                lines = lf + cr - crlf + (n > 0 and not ended)
                modified = dt.datetime(*info.date_time)
                yield pa.RecordBatch.from_pylist([dict(archive_name=row["archive_name"], member_name=info.filename, byte_count=n, sha256=digest.hexdigest(), lf=lf - crlf, crlf=crlf, lone_cr=cr - crlf, non_ascii=high, ends_with_newline=ended, physical_lines=int(lines), crc32=info.CRC, compressed_bytes=info.compress_size, modified_at=modified, compression=info.compress_type, archive_sha256=archive.hexdigest())], TALLY_ARROW)

    return _members(spark, path).mapInArrow(run, TALLY)


def write_archive(path: str, members: dict[str, list[list[str]]], header: list[str] | None = None) -> None:
    """A zip of CSV members, for fixtures."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, records in members.items():
            text = io.StringIO()
            csv.writer(text, lineterminator="\r\n").writerows([header or HEADER, *records])
            z.writestr(name, text.getvalue())
