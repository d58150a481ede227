"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import truncation
from quern.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Responses whose text lost its end."""
    return truncation.truncated(table(spark, d, "llm_responses"), table(spark, d, "llm_requests")).select("response_id").distinct()


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.truncation_shares(table(spark, d, "llm_responses"), table(spark, d, "llm_requests"))


def p1_limits(spark: SparkSession, d: str) -> DataFrame:
    """Hidden storage limits: lengths at which the texts of a source pile up."""
    return truncation.storage_limits(table(spark, d, "llm_responses"))


QUERIES = {f.__name__: f for f in (p1_found, p1_shares, p1_limits)}
SQL: dict[str, str] = {}
