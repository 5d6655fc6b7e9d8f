"""All registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("detection", "evidence", "web", "history", "recovered", "scans")


def _modules():
    return [import_module(f"lanternfish.plans.{m}") for m in MODULES]


def queries() -> dict:
    return {f.__name__: f for m in _modules() for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
