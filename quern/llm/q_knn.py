"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.knn import nearest
from quern.sources.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of cosine 0.8 or more where one is among the other's five most similar."""
    near = nearest(table(spark, d, "vector_index"), k=5, min_similarity=0.8)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar ids of every twentieth id (by digest), against all rows."""
    asked = F.pmod(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long"), F.lit(20)) == 0
    near = nearest(table(spark, d, "vector_index"), k=5, probes=32, queries=asked)
    return near.select("namespace", "id", "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


QUERIES = {f.__name__: f for f in (p5_found, p5_neighbours)}
_USABLE = """v AS (SELECT namespace, id, any_value(vector)::DOUBLE[] AS v FROM vector_index
            WHERE len(vector) = 128 AND list_max(list_transform(vector, lambda x: abs(x))) > 0 GROUP BY 1, 2)"""
SQL = {
    "p5_neighbours": f"""
        WITH {_USABLE}, q AS (SELECT * FROM v WHERE CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) % 20 = 0),
        p AS (SELECT a.namespace, a.id, b.id AS neighbour, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM q a JOIN v b ON a.namespace = b.namespace AND a.id <> b.id)
        SELECT namespace, id, neighbour, round(s, 6) AS similarity, CAST(rank AS INT) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY namespace, id ORDER BY s DESC, neighbour) AS rank FROM p) WHERE rank <= 5""",
    "p5_found": f"""
        WITH {_USABLE},
        p AS (SELECT a.namespace, a.id AS x, b.id AS y, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM v a JOIN v b ON a.namespace = b.namespace AND a.id <> b.id),
        r AS (SELECT *, row_number() OVER (PARTITION BY namespace, x ORDER BY s DESC, y) AS r FROM p)
        SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM r WHERE r <= 5 AND s >= 0.8""",
}
