"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import names
from quern.sources.tables import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spellings of one person, organisation or place."""
    return names.variant_pairs(table(spark, d, "entities").select("name", "type"))


def p6_variants(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with the spelling its cluster is named after."""
    return names.variants(table(spark, d, "entities").select("name", "type"))


QUERIES = {f.__name__: f for f in (p6_found, p6_variants)}
SQL: dict[str, str] = {}
