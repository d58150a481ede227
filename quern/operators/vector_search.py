"""Exact vector search over a keyed index, and its upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import store


class DimensionMismatch(ValueError):
    """A vector whose length is not that of the index."""


def dimension(index: DataFrame, vector: str = "vector") -> int | None:
    """Length of the vectors: that of the most rows, null and empty ones aside."""
    sizes = index.select(F.size(vector).alias("n")).filter("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("rows"))
    row = sizes.orderBy(F.desc("rows"), F.desc("n")).first()
    return row["n"] if row else None


def check(records: DataFrame, dim: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """The records, or an error if one has an empty key or another length: all or nothing."""
    bad = records.filter(F.coalesce(F.col(key), F.lit("")) == "").limit(1).count()
    if bad:
        raise ValueError("a record has no key")
    wrong = records.filter(F.coalesce(F.size(vector), F.lit(-1)) != dim).select(F.size(vector).alias("n")).first()
    if wrong:
        raise DimensionMismatch(f"vector of {wrong['n']} components in an index of {dim}")
    return records


def upsert(index: DataFrame, records: DataFrame, key: str = "id", order: str | None = None, vector: str = "vector") -> DataFrame:
    """Replaces rows by key, after checking every record."""
    dim = dimension(index, vector) or dimension(records, vector)
    checked = check(records, dim, key, vector) if dim else records
    return store.upsert(index, checked, key, *([order] if order else []))


def score(index: DataFrame, query: list[float], vector: str = "vector", norm: str | None = None) -> DataFrame:
    """Adds ``score``, the cosine with one query; the query and its length are literals."""
    q = F.array(*[F.lit(float(x)) for x in query])
    length = sum(float(x) * float(x) for x in query) ** 0.5
    return index.withColumn("score", V.cosine(F.col(vector), q, F.col(norm) if norm else None, F.lit(length)))


def top_k(index: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "vector", threshold: float | None = None, norm: str | None = None) -> DataFrame:
    """The ``k`` best rows by score, then key; none for ``k`` of 0 or less.

    The vector is not part of the result, and the plan keeps k rows per task.
    """
    hits = score(index, query, vector, norm).drop(vector)
    if threshold is not None:
        hits = hits.filter(F.col("score") >= threshold)
    return hits.orderBy(F.desc("score"), key).limit(max(k, 0))


def top_k_batch(index: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "vector", query_key: str = "query_id",
                query_vector: str = "query_vector", threshold: float | None = None, largest: int = 10_000) -> DataFrame:
    """The ``k`` best rows for each of a set of queries: ``query_id, id, score, rank``.

    ``queries`` is a stated set, not the index itself; it is broadcast when it has
    at most ``largest`` rows and compared in blocks of that many otherwise.
    """
    stated = queries.select(query_key, F.col(query_vector).alias("_q"), V.norm(F.col(query_vector)).alias("_qn"))
    scanned = index.select(F.col(key), F.col(vector).alias("_v"), V.norm(F.col(vector)).alias("_vn"))
    blocks = max(1, -(-stated.count() // largest))
    parts = [F.broadcast(stated.filter(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b)) for b in range(blocks)]
    best = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    out = None
    for part in parts:
        hits = scanned.crossJoin(part).select(query_key, key, V.cosine(F.col("_v"), F.col("_q"), F.col("_vn"), F.col("_qn")).alias("score"))
        if threshold is not None:
            hits = hits.filter(F.col("score") >= threshold)
        # The rank is bounded, so every task keeps k rows a query before anything is shuffled.
        top = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        out = top if out is None else out.unionByName(top)
    return out


def dedup_hits(hits: DataFrame, key: str = "id") -> DataFrame:
    """Each id with its best score."""
    return hits.groupBy(key).agg(F.max("score").alias("score"))


def usable(vector: Column, dim: int) -> Column:
    """Why a vector can or cannot be searched: ``ok, null, empty, length, zero``."""
    return (F.when(vector.isNull(), "null").when(F.size(vector) == 0, "empty").when(F.size(vector) != dim, "length")
            .when(V.norm(vector) == 0, "zero").otherwise("ok"))
