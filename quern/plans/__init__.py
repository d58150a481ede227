"""Query catalogue: one callable and, where possible, one SQL text per name."""

from __future__ import annotations

import importlib

#: Modules of this package that define ``QUERIES`` and ``SQL``.
MODULES = ["skew", "documents", "knowledge", "answers"]


def catalogue() -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"quern.plans.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
