"""Baselines of a warehouse's content, their comparison field by field, and what a result rests on."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import pathlib
import platform
import uuid

import pyspark
from pyspark.sql import DataFrame, SparkSession

from gridloom.operators import digests
from gridloom.sources.bundles import canonical_bytes, section
from gridloom.sources.warehouse import pipeline_fingerprint
from gridloom.storage import read_bytes, write_bytes


def module_digest(*names: str) -> str:
    """SHA-256 over named modules of this package: the identity of one policy or calculation."""
    root = pathlib.Path(__file__).resolve().parent.parent
    h = hashlib.sha256()
    for name in sorted(names):
        h.update(name.encode() + b"\0" + (root / f"{name}.py").read_bytes() + b"\0")
    return h.hexdigest()


def identity(spark: SparkSession) -> dict[str, str]:
    """What a result rests on besides its data: all code, the reading policy, the calculations, and the runtime."""
    return {
        "code": pipeline_fingerprint(),
        "policy": module_digest("operators/policy", "functions/text"),
        "calculation": module_digest("operators/analytics", "functions/display"),
        "model": module_digest("operators/forecast", "operators/daily"),
        "runtime": f"python {platform.python_version()}, pyspark {pyspark.__version__}, spark {spark.version}",
    }


def capture(relations: dict[str, DataFrame], totals: dict[str, tuple[DataFrame, str]], without: tuple[str, ...] = ()) -> dict:
    """A baseline: schema, row count and content digest of each relation, and exact totals by group as text.

    ``totals`` names (fact, grouping column) pairs; ``without`` are provenance columns. All fields
    are text, so equal baselines have equal bytes. Groups must be few: bands, months or reasons.
    """
    evidence = {name: digests.evidence(df, name, without).first().asDict() for name, df in relations.items()}
    grouped = {name: {str(r["key"]): {k: str(v) for k, v in r.items() if k != "key"} for r in section(digests.grouped_totals(df, by), ["key"])} for name, (df, by) in totals.items()}
    return {"format": "baseline-2", "relations": {n: {k: str(v) for k, v in e.items() if k != "relation"} for n, e in evidence.items()}, "totals": grouped}


def _fields(tree, at: str = "") -> dict[str, str]:
    if not isinstance(tree, dict):
        return {at: str(tree)}
    return {k: v for name, sub in tree.items() for k, v in _fields(sub, f"{at}/{name}").items()}


def compare(base: dict, other: dict) -> list[dict[str, str | None]]:
    """Each field that differs, with both values, None where a side lacks it; empty if the baselines agree."""
    a, b = _fields(base), _fields(other)
    return [{"field": f, "base": a.get(f), "other": b.get(f)} for f in sorted(a.keys() | b.keys()) if a.get(f) != b.get(f)]


def save(spark: SparkSession, path: str, baseline: dict) -> str:
    """Write a baseline; returns the SHA-256 of its bytes. An existing other one is refused, not replaced."""
    data = canonical_bytes(baseline)
    if not write_bytes(spark, path, data, overwrite=False) and read_bytes(spark, path) != data:
        raise FileExistsError(path)
    return hashlib.sha256(data).hexdigest()


def applicability(report: dict, seen: dict) -> dict:
    """Whether a saved report still speaks of the data at hand.

    ``report`` holds what was true when it was made, ``seen`` what is recomputed now. A check both
    can answer agrees or not; one the report or the data cannot answer is unverifiable. The verdict is
    ``mismatched`` if any differs, else ``unverifiable`` if any cannot be told, else ``applicable``.
    """
    a, b = _fields(report), _fields(seen)
    checks = {f: "unverifiable" if a.get(f) in (None, "None") or b.get(f) in (None, "None") else "agrees" if a[f] == b[f] else "differs" for f in sorted(a.keys() | b.keys())}
    states = set(checks.values())
    verdict = "mismatched" if "differs" in states else "unverifiable" if "unverifiable" in states or not checks else "applicable"
    return {"verdict": verdict, "checks": checks}


class Attempt:
    """A build's record: ``started`` before it, then ``succeeded`` or ``failed``, each a file of its own.

    ``required`` names the nodes (tables and checks) that must have been reported for success.
    """

    def __init__(self, spark: SparkSession, root: str, required: list[str]):
        self.spark, self.root, self.required = spark, root, list(required)
        self.id, self.done = uuid.uuid4().hex, {}

    def _note(self, state: str, more: dict) -> None:
        record = {"attempt": self.id, "state": state, "at": dt.datetime.now(dt.UTC).isoformat(), "nodes": self.done} | more
        write_bytes(self.spark, f"{self.root}/attempts/{self.id}-{state}.json", json.dumps(record, sort_keys=True).encode())

    def __enter__(self) -> Attempt:
        self._note("started", {"required": self.required})
        return self

    def node(self, name: str, ok: bool = True) -> None:
        self.done[name] = bool(ok)

    def missing(self) -> list[str]:
        """Required nodes not reported, or reported as failed."""
        return [n for n in self.required if not self.done.get(n)]

    def __exit__(self, kind, error, trace) -> bool:
        if kind is None and not self.missing():
            self._note("succeeded", {})
            return False
        self._note("failed", {"error": repr(error) if error else f"incomplete: {self.missing()}"})
        if kind is None:
            raise RuntimeError(f"incomplete build: {self.missing()}")
        return False
