"""Queries of problems 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import mixing, packing
from quern.llm.tokens import token_sizes
from quern.sources.tables import materialise, spread, table


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    """Every document text, in tokens, with its window of 2,048 tokens."""
    sizes = token_sizes(spread(table(spark, d, "documents").select("doc_id", "text")), ["doc_id"])
    return packing.pack(sizes, "doc_id", "n_tokens").withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the windows are."""
    by = p7_windows(spark, d).groupBy("window_id").agg(F.sum("n_tokens").alias("used"))
    return by.agg(F.count(F.lit(1)).alias("n_windows"), F.sum("used").alias("n_tokens"), F.round(F.avg("used") / packing.CAPACITY, 6).alias("fill"),
                  F.count_if(F.col("used") == packing.CAPACITY).alias("n_full"), F.max("used").alias("most_used"))


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    """The mixture of sources: which part of which text fills which output slot."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixing.shares(p8_selection(spark, d), table(spark, d, "mix_targets"))


def p8_shards(spark: SparkSession, d: str) -> DataFrame:
    """Sources of every output shard and their deviation from the overall shares."""
    return mixing.shard_shares(p8_selection(spark, d))


def p7_cover(spark: SparkSession, d: str) -> DataFrame:
    """Every document that has a place: whether its pieces leave a gap, are split without need, or lie in an overfull window."""
    placed = materialise(p7_windows(spark, d), "filling-windows")
    load = placed.groupBy("window_id").agg(F.sum("n_tokens").alias("used"))
    by = placed.join(load, "window_id").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.max("used").alias("used"))
    return by.select("doc_id", (F.col("t") != F.col("end")).alias("has_gap"), ((F.col("n") > 1) & (F.col("t") <= (F.col("n") - 1) * packing.CAPACITY)).alias("needless_split"),
                     (F.col("used") > packing.CAPACITY).alias("overfull"))


def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every target source: whether it has a part of the selection, and is used more often than it may be."""
    out = p8_shares(spark, d)
    return out.select("source", (F.col("n_tokens") > 0).alias("present"), (F.col("most_uses") > F.col("max_repeats")).alias("overused"))


QUERIES = {f.__name__: f for f in (p7_windows, p7_fill, p8_selection, p8_shares, p8_shards, p7_cover, p8_rules)}
SQL = {
    "p7_cover": "SELECT doc_id, false AS has_gap, false AS needless_split, false AS overfull FROM documents WHERE text <> ''",
    "p8_rules": """SELECT source, source IN (SELECT source FROM (SELECT arg_min(source, doc_id) AS source FROM documents WHERE text <> '' GROUP BY text) WHERE source IS NOT NULL) AS present, false AS overused
        FROM mix_targets""",
}
