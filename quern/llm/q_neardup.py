"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.neardup import link_counts, near_duplicates
from quern.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Near-equal chunk contents and entity descriptions: three-word runs, half shared, 24 words."""
    chunks = near_duplicates(table(spark, d, "chunks"), "chunk_id", "content", k=3, threshold=0.5, min_words=24)
    mentions = near_duplicates(table(spark, d, "entities"), "mention_id", "description", k=3, threshold=0.5, min_words=24)
    named = [x.select(F.lit(n).alias("field_name"), "id_a", "id_b") for n, x in (("chunks.content", chunks), ("entities.description", mentions))]
    return named[0].unionByName(named[1])


def p2_chunk_links(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with its class of equal texts and its links at the default setting: five-word runs, similarity 0.8."""
    return link_counts(table(spark, d, "chunks"), "chunk_id", "content").withColumnRenamed("id", "chunk_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_chunk_links)}
SQL = {
    # All pairs of chunks that share a run of five words, by brute force.
    "p2_chunk_links": r"""
        WITH c AS (SELECT chunk_id, any_value(content) AS t FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1),
        w AS (SELECT chunk_id, t, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM c),
        s AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) >= 5),
        n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.chunk_id <> b.chunk_id GROUP BY 1, 2),
        l AS (SELECT a, count(*) AS n_links FROM p JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9 GROUP BY 1)
        SELECT c.chunk_id, CASE WHEN t IS NOT NULL THEN min(c.chunk_id) OVER (PARTITION BY t) END AS class_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN l ON l.a = c.chunk_id""",
}
