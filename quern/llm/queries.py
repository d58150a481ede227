"""Catalogue of this subpackage."""

from __future__ import annotations

import importlib

MODULES: list[str] = ["q_neardup", "q_truncation", "q_knn", "q_splitting", "q_filling", "q_names", "q_subjects"]

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"quern.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
