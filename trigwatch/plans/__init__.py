"""Every operator bound to the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

import importlib

from trigwatch.plans.registry import ORACLES, QUERIES

MODULES = ("scans", "columns", "checks", "lookups", "aggregates", "vectors", "store", "evaluation", "alerts", "clusters", "models", "streams")


def load_all() -> tuple[dict, dict]:
    for name in MODULES:
        importlib.import_module(f"trigwatch.plans.{name}")
    return QUERIES, ORACLES
