"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import splitting
from quern.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with more than 240 tokens: those the operator cuts."""
    pieces = splitting.split_oversized(table(spark, d, "chunks"), "chunk_id", "content")
    return pieces.filter("n_pieces > 1").select(F.col("id").alias("chunk_id")).distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All chunks in pieces of at most 240 tokens, numbered anew within their documents."""
    chunks = table(spark, d, "chunks").filter("chunk_id is not null")
    # Deliveries of a chunk have the same text; one is kept before anything is moved but its id. The order is a struct, which is never null.
    first = F.min_by(F.struct("doc_id", "content", "chunk_order_index"), F.struct("created_at", "doc_id", "chunk_order_index"))
    once = chunks.groupBy("chunk_id").agg(first.alias("c")).select("chunk_id", "c.*")
    suffix = F.regexp_extract("chunk_id", r"::chunk-(\d{1,9})$", 1)
    # A chunk's id carries its place; the column may be null.
    placed = once.withColumn("place", F.coalesce("chunk_order_index", F.nullif(suffix, F.lit("")).cast("int"), F.lit(0)))
    key = placed.withColumn("id", F.struct("chunk_id", "doc_id", "place"))
    pieces = splitting.split_oversized(key.withColumn("id", F.to_json("id")), "id", "content")
    back = pieces.withColumn("k", F.from_json("id", "chunk_id string, doc_id string, place int")).select(
        F.col("k.chunk_id").alias("id"), F.col("k.doc_id").alias("doc_id"), F.col("k.place").alias("place"), "piece_no", "n_pieces", "content", "n_tokens")
    out = splitting.renumber(back)
    return out.select(F.col("id").alias("chunk_id"), "doc_id", "piece_no", "chunk_order_index", "n_tokens", "content")


def p4_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk put together from its pieces without what they repeat: a checksum of its tokens, and whether the pieces keep the limit."""
    pieces = p4_pieces(spark, d)
    words = F.filter(F.split("content", f"[{splitting.SPACE}]+"), lambda x: x != "")
    own = F.when(F.col("piece_no") == 0, words).otherwise(F.slice(words, splitting.OVERLAP + 1, splitting.MAX_TOKENS))
    # A text has as many pieces as it has lengths of the limit, so a row of them is as large as the text.
    parts = pieces.withColumn("own", own).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "own"))).alias("p"), F.max("n_tokens").alias("most"))
    return parts.select("chunk_id", (F.col("most") <= splitting.MAX_TOKENS).alias("within"), F.md5(F.array_join(F.flatten(F.transform("p", lambda x: F.coalesce(x["own"], F.array().cast("array<string>")))), " ")).alias("tokens_md5"))


QUERIES = {f.__name__: f for f in (p4_found, p4_pieces, p4_rebuilt)}
_FIELDS = r"regexp_extract_all(content, '[^\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')"
SQL = {
    "p4_rebuilt": f"""
        SELECT chunk_id, true AS within, md5(array_to_string(coalesce({_FIELDS}, []), ' ')) AS tokens_md5
        FROM (SELECT chunk_id, arg_min(content, coalesce(created_at, TIMESTAMP '1900-01-01')) AS content FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1)""",
    "p4_found": r"""
        SELECT DISTINCT chunk_id FROM chunks
        WHERE len(regexp_extract_all(content, '[^\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) > 240""",
}
