"""Queries of the hot-key operator (p3) and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import hotkeys
from quern.sources.tables import table


def _fields(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    """The three keyed collections; re-delivered rows count."""
    return [
        ("relations.src_id", table(spark, d, "relations").select(F.col("src_id").alias("key_value"))),
        ("entities.source_ids", table(spark, d, "entities").select(F.explode("source_ids").alias("key_value"))),
        ("entities.description", table(spark, d, "entities").select(F.col("description").alias("key_value"))),
    ]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Key values that hold at least 2 % of all rows or elements of their field."""
    parts = [hotkeys.heavy_keys(df, "key_value").select(F.lit(name).alias("field_name"), "key_value") for name, df in _fields(spark, d)]
    return reduce(DataFrame.unionByName, parts)


def p3_src_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows and summed weight of every relation source, chunk states merged."""
    out = hotkeys.chunked_aggregate(table(spark, d, "relations").select("src_id", "weight"), "src_id", "weight")
    return out.select("src_id", F.col("n").alias("n_rows"), F.round("sum_weight", 2).alias("sum_weight"))


def p3_element_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every chunk id that mentions point to."""
    df = table(spark, d, "entities").select(F.explode("source_ids").alias("source_id"))
    return hotkeys.key_totals(df, "source_id").select("source_id", F.col("n").alias("n_mentions"))


def p3_source_lists(spark: SparkSession, d: str) -> DataFrame:
    """Distinct chunk ids of every relation source, as list sizes over bounded segments."""
    lists = hotkeys.merged_lists(table(spark, d, "relations").select("src_id", "source_ids"), "src_id", "source_ids")
    # The segments are merged to one fingerprint per key; sums of hashes need no order.
    return lists.groupBy("src_id").agg(
        F.sum("n_elements").alias("n_sources"),
        F.min(F.element_at("elements", 1)).alias("first_source"),
        F.max(F.element_at("elements", -1)).alias("last_source"))


def p3_src_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Relations of every source in chunks of 100 by id, with the weight of the chunks before."""
    out = hotkeys.ordered_chunks(table(spark, d, "relations").select("src_id", "rel_id", "weight"), "src_id", "rel_id", "weight", 100)
    return out.select("src_id", "chunk_no", F.col("n").alias("n_rows"), F.round("sum_weight", 2).alias("sum_weight"), F.col("first").alias("first_rel"), F.col("last").alias("last_rel"),
                      F.round("weight_before", 2).alias("weight_before"))


def p3_description_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every mention description."""
    return hotkeys.key_totals(table(spark, d, "entities").select("description"), "description").withColumnRenamed("n", "n_mentions")


def _lists(spark: SparkSession, d: str, segment: int) -> DataFrame:
    relations, entities = table(spark, d, "relations"), table(spark, d, "entities")
    fields = [
        ("relations.src_id", relations.select(F.col("src_id").alias("key_value"), F.col("source_ids").alias("xs"))),
        ("entities.source_ids", entities.select(F.explode("source_ids").alias("key_value"), F.array("mention_id").alias("xs"))),
        ("entities.description", entities.select(F.col("description").alias("key_value"), F.col("source_ids").alias("xs"))),
    ]
    return reduce(DataFrame.unionByName, [hotkeys.merged_lists(df, "key_value", "xs", segment).select(F.lit(name).alias("field_name"), "*") for name, df in fields])


def p3_merged_lists(spark: SparkSession, d: str) -> DataFrame:
    """The merged lists in segments: chunk ids of every relation source and description, mention ids of every chunk id."""
    return _lists(spark, d, 1000)


def p3_list_digests(spark: SparkSession, d: str) -> DataFrame:
    """The merged lists in segments of 50, each as one checksum."""
    return _lists(spark, d, 50).select("field_name", "key_value", "segment_no", "n_elements", F.md5(F.array_join("elements", "|")).alias("elements_md5"))


QUERIES = {f.__name__: f for f in (p3_found, p3_src_totals, p3_src_chunks, p3_element_counts, p3_description_counts, p3_source_lists, p3_merged_lists, p3_list_digests)}

SQL = {
    "p3_found": """
        WITH f AS (
          SELECT 'relations.src_id' AS field_name, src_id AS key_value FROM relations
          UNION ALL SELECT 'entities.source_ids', unnest(source_ids) FROM entities
          UNION ALL SELECT 'entities.description', description FROM entities),
        n AS (SELECT field_name, count(*) AS total FROM f GROUP BY 1)
        SELECT f.field_name, f.key_value FROM f JOIN n USING (field_name)
        WHERE f.key_value IS NOT NULL AND f.key_value <> ''
        GROUP BY f.field_name, f.key_value, n.total HAVING count(*) >= 0.02 * n.total""",
    "p3_src_totals": """
        SELECT src_id, count(*) AS n_rows, round(sum(CAST(round(weight * 1000) AS BIGINT)) / 1000.0, 2) AS sum_weight
        FROM relations WHERE src_id <> '' GROUP BY 1""",
    # Re-delivered rows repeat id and weight, so the order of equal ids alters nothing.
    "p3_src_chunks": """
        WITH r AS (SELECT src_id, rel_id, coalesce(CAST(round(weight * 1000) AS BIGINT), 0) AS w,
          (row_number() OVER (PARTITION BY src_id ORDER BY rel_id) - 1) // 100 AS chunk_no FROM relations WHERE src_id <> ''),
        s AS (SELECT src_id, chunk_no, count(*) AS n_rows, sum(w) AS w, min(rel_id) AS first_rel, max(rel_id) AS last_rel FROM r GROUP BY 1, 2)
        SELECT src_id, chunk_no, n_rows, round(w / 1000.0::DOUBLE, 2) AS sum_weight, first_rel, last_rel,
          round(coalesce(sum(w) OVER (PARTITION BY src_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000.0::DOUBLE, 2) AS weight_before FROM s""",
    "p3_element_counts": """
        SELECT source_id, count(*) AS n_mentions FROM (SELECT unnest(source_ids) AS source_id FROM entities)
        WHERE source_id <> '' GROUP BY 1""",
    "p3_description_counts": "SELECT description, count(*) AS n_mentions FROM entities WHERE description <> '' GROUP BY 1",
    "p3_list_digests": """
        WITH f AS (
          SELECT 'relations.src_id' AS field_name, src_id AS key_value, unnest(source_ids) AS e FROM relations
          UNION ALL SELECT 'entities.source_ids', unnest(source_ids), mention_id FROM entities
          UNION ALL SELECT 'entities.description', description, unnest(source_ids) FROM entities),
        n AS (SELECT *, (row_number() OVER (PARTITION BY field_name, key_value ORDER BY e) - 1) // 50 AS segment_no
          FROM (SELECT DISTINCT * FROM f WHERE key_value <> '' AND e <> ''))
        SELECT field_name, key_value, segment_no, CAST(count(*) AS INT) AS n_elements, md5(string_agg(e, '|' ORDER BY e)) AS elements_md5 FROM n GROUP BY 1, 2, 3""",
    "p3_source_lists": """
        SELECT src_id, count(DISTINCT s) AS n_sources, min(s) AS first_source, max(s) AS last_source
        FROM (SELECT src_id, unnest(source_ids) AS s FROM relations WHERE src_id <> '') WHERE s <> '' GROUP BY 1""",
}
