"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.subjects import document_subjects
from quern.sources.tables import table


def _found(spark: SparkSession, d: str) -> DataFrame:
    return document_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Subjects to which at least a fifth of a document's statements belong."""
    return _found(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each subject in the corpus."""
    return _found(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents"), F.round(F.avg("share"), 6).alias("mean_share"))


QUERIES = {f.__name__: f for f in (p9_found, p9_composition)}
SQL: dict[str, str] = {}
