"""All core queries and SQL twins in one place."""

from __future__ import annotations

from gridloom.plans import problems, reference, reports

_MODULES = [problems, reference, reports]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
