"""Deterministic JSON bundles of small results, with a manifest that pins them."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import json
import os
import pathlib
import shutil
import tempfile

from pyspark.sql import DataFrame

MOST_ROWS = 100_000


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    if isinstance(value, dt.date | dt.datetime):
        return value.isoformat()
    return value


def section(df: DataFrame, order: list[str], most: int = MOST_ROWS) -> list[dict]:
    """The rows of a report in a fixed order, decimals as exact text; a larger result is refused, not cut."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a section may hold {most} rows")
    return [{k: _plain(v) for k, v in r.asDict(recursive=True).items()} for r in rows]


def canonical_bytes(document) -> bytes:
    """Sorted keys, no blanks, one line end: the same document always gives the same bytes."""
    return json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode() + b"\n"


def write_atomically(path: str, data: bytes) -> None:
    """Write beside the target, flush to disk, then rename over it."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        pathlib.Path(temporary).unlink(missing_ok=True)
        raise


def write_bundle(folder: str, sections: dict[str, list[dict]]) -> dict:
    """One file a section and a manifest of sizes and digests, written last."""
    os.makedirs(folder, exist_ok=True)
    manifest = {}
    for name, rows in sections.items():
        data = canonical_bytes(rows)
        manifest[name] = {"bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), "rows": len(rows)}
        write_atomically(f"{folder}/{name}.json", data)
    write_atomically(f"{folder}/manifest.json", canonical_bytes(manifest))
    return manifest


def verify_bundle(folder: str) -> list[str]:
    """What does not hold: missing files and files whose bytes are not the manifest's; empty if all does."""
    manifest = json.loads(pathlib.Path(folder, "manifest.json").read_bytes())
    problems = []
    for name, entry in manifest.items():
        path = pathlib.Path(folder, f"{name}.json")
        if not path.exists():
            problems.append(f"{name}: missing")
        elif hashlib.sha256(path.read_bytes()).hexdigest() != entry["sha256"]:
            problems.append(f"{name}: changed")
    return problems


def write_report(folder: str, title: str, sections: dict[str, tuple[DataFrame, list[str]]]) -> dict:
    """A report as JSON sections with a manifest and as one Markdown page beside them.

    ``sections`` names (rows, order) pairs; each is refused above ``MOST_ROWS`` rows, not cut.
    """
    rows = {name: section(df, order) for name, (df, order) in sections.items()}
    manifest = write_bundle(folder, rows)
    lines = [f"# {title}", ""]
    for name, own in rows.items():
        lines += [f"## {name}", "", f"{len(own)} row(s)", ""]
        if own:
            lines += ["| " + " | ".join(own[0]) + " |", "|" + "-|" * len(own[0])]
            lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r.values()) + " |" for r in own] + [""]
    write_atomically(f"{folder}/report.md", "\n".join(lines).encode())
    return manifest


def snapshot(source: str, target: str) -> dict[str, str]:
    """Copy a folder warehouse whole, under a temporary name that is renamed last; returns the SHA-256 of each file.

    The target must not exist yet: a snapshot is never mixed with another.
    """
    if os.path.exists(target):
        raise FileExistsError(target)
    beside = f"{target}.part"
    shutil.rmtree(beside, ignore_errors=True)
    shutil.copytree(source, beside)
    seen = {str(p.relative_to(beside)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(pathlib.Path(beside).rglob("*")) if p.is_file()}
    os.rename(beside, target)
    return seen
