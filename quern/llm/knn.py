"""Most similar vectors by randomly rotated one-bit codes.

Unit vectors are turned by one random rotation; the signs of the turned
components are the code (one bit each) and the inner product of the vector with
its code direction is the correction scalar.  For a query ``q`` and a code ``s``
with scalar ``a`` the estimate ``<q, s> / (a sqrt(D))`` of the cosine is unbiased
with a deviation of about ``sqrt((1 - a^2) / a^2 / (D - 1))``.  Vectors whose
estimate plus ``BOUND`` deviations could still reach the k-th best lower bound
(or the wanted similarity) are reranked by the exact inner product.

Every vector is indexed in the list of its nearest centroid, with its code and
scalar, which are made once; a query is compared with the ``probes`` nearest lists,
by codes first, and the vectors themselves are read for what may be an answer only.  Centroids come from a sample of at most
``SAMPLE`` vectors per namespace, or ``PER_LIST`` a list, of which there are at most
``MAX_LISTS``; everything else covers all vectors.  Lists and
their queries are cut into blocks, so no task holds a whole large list.

Exact copies of a vector are one class, found by hash; only the ``k + 1``
smallest ids of a class can ever be an answer, so a class of any size costs no
more than one vector.

Defined results: null, empty, all-zero and too short vectors and vectors with
null or non-finite parts take no part; a repeated id counts once; ties go by the
smaller id; a namespace with one vector gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.tables import materialise

SAMPLE, PER_LIST, LIST_SIZE, MAX_LISTS = 20_000, 20, 500, 4096
INDEX_BLOCK, QUERY_BLOCK = 4_000, 8_000
#: Deviations within which an estimate is trusted.
BOUND = 3.0


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction scalars of unit vectors."""
    turned = unit @ turn
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def estimate(queries: np.ndarray, bits: np.ndarray, scalars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of turned unit queries with coded vectors, and their deviation per code."""
    dim = queries.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    a = np.maximum(scalars, 1e-6).astype(np.float32)
    return (queries @ signs.T) / (a * np.sqrt(dim, dtype=np.float32)), np.sqrt(np.maximum(1 - a * a, 0) / (a * a) / max(dim - 1, 1))


def _raw(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)


def _unit(column, dim: int) -> np.ndarray:
    x = _raw(column, dim).astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def train(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    c = sample[np.random.default_rng(seed).choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-9), c)
    return c.astype(np.float32)


def usable(df: DataFrame, dim: int) -> DataFrame:
    """``namespace, id, vector`` of the vectors that take part."""
    v = F.col("vector")
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return (df.select("namespace", "id", "vector").filter(F.col("id").isNotNull() & (F.size(v) == dim))
            .filter(~F.exists(v, lambda x: x.isNull() | F.isnan(x))).filter((square > 0) & (square < float("inf"))))


def nearest(df: DataFrame, k: int = 5, dim: int = 128, min_similarity: float = -1.0, probes: int = 6, queries=None) -> DataFrame:
    """``namespace, id, neighbour, similarity, rank`` of the ``k`` most similar other ids.

    Only neighbours of at least ``min_similarity`` are given.  ``queries`` is a
    condition on ``id``; by default every vector is a query.
    """
    spark = df.sparkSession
    rows = usable(df, dim).withColumn("h", F.xxhash64("vector")).withColumn("namespace", F.coalesce("namespace", F.lit("")))
    classes = materialise(rows.groupBy("namespace", "h").agg(
        F.first("vector").alias("vector"), F.max(queries if queries is not None else F.lit(True)).alias("asked")), "knn-classes")
    member = rows.select("namespace", "h", "id").distinct()
    sizes = {r["namespace"]: r["n"] for r in classes.groupBy("namespace").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a namespace
    centroids = {}
    for ns, n in sizes.items():
        lists = int(min(max(n // LIST_SIZE, 1), MAX_LISTS))
        picked = classes.filter(F.col("namespace") == ns).orderBy(F.xxhash64("h"), "h").select("vector").limit(max(SAMPLE, PER_LIST * lists)).toArrow()
        centroids[ns] = train(_unit(picked.column("vector"), dim), lists)
    shared = spark.sparkContext.broadcast(centroids)  # at most MAX_LISTS * dim floats a namespace

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, names = _unit(batch.column("vector"), dim), np.array(batch.column("namespace").to_pylist(), object)
            near = np.full((len(unit), probes), -1, np.int32)
            for ns in set(names):
                at = np.flatnonzero(names == ns)
                c = shared.value[ns]
                order = np.argsort(-(unit[at] @ c.T), axis=1, kind="stable")[:, :probes]
                near[at[:, None], np.arange(order.shape[1])] = order
            bits, scalars = encode(unit, turn)
            yield pa.RecordBatch.from_arrays([
                batch.column("namespace"), batch.column("h"), batch.column("asked"), pa.array([x.tobytes() for x in _raw(batch.column("vector"), dim)], pa.binary()),
                pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(scalars.astype(np.float32)),
                pa.array([x[x >= 0].tolist() for x in near], pa.list_(pa.int32()))], names=["namespace", "h", "asked", "raw", "code", "scalar", "near"])

    turn = rotation(dim)
    placed = materialise(classes.mapInArrow(assign, "namespace string, h long, asked boolean, raw binary, code binary, scalar float, near array<int>"), "knn-lists")
    index = placed.select("namespace", F.col("near")[0].alias("list"), "h", "raw", "code", "scalar", F.lit(False).alias("is_query"))
    none = [F.lit(None).cast("binary").alias("code"), F.lit(None).cast("float").alias("scalar")]
    query = placed.filter("asked").select("namespace", F.explode("near").alias("list"), "h", "raw", *none, F.lit(True).alias("is_query"))
    both = index.unionByName(query)
    # Blocks of a list: one small row per list, at most MAX_LISTS a namespace.
    loads = (both.groupBy("namespace", "list").agg(F.count_if(~F.col("is_query")).alias("ni"), F.count_if("is_query").alias("nq"))
             .select("namespace", "list", F.ceil(F.col("ni") / INDEX_BLOCK).cast("int").alias("bi"), F.ceil(F.col("nq") / QUERY_BLOCK).cast("int").alias("bq")).filter("bi > 0 and bq > 0"))
    part = F.pmod(F.xxhash64("h"), F.when(F.col("is_query"), F.col("bq")).otherwise(F.col("bi"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("is_query"), F.col("bi")).otherwise(F.col("bq")) - 1))
    spread = (both.join(F.broadcast(loads), ["namespace", "list"]).withColumn("mine", part).withColumn("other", other)
              .select("namespace", "list", F.when(F.col("is_query"), F.col("mine")).otherwise(F.col("other")).alias("qb"),
                      F.when(F.col("is_query"), F.col("other")).otherwise(F.col("mine")).alias("ib"), "h", "raw", "code", "scalar", "is_query"))

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(pdf["raw"]), np.float32).reshape(-1, dim).astype(np.float64)
        size = np.linalg.norm(raw, axis=1)
        unit = (raw / size[:, None]).astype(np.float32)
        asks, h = pdf["is_query"].to_numpy(bool), pdf["h"].to_numpy()
        x, hx, q, hq = unit[~asks], h[~asks], unit[asks], h[asks]
        rx, rq, nx, nq = raw[~asks], raw[asks], size[~asks], size[asks]
        found = []
        if len(x) and len(q):
            own = pdf[~asks]
            bits, scalars = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(x), -1), own["scalar"].to_numpy(np.float32)
            for start in range(0, len(q), 512):
                part_q = q[start : start + 512]
                est, dev = estimate(part_q @ turn, bits, scalars)
                low = est - BOUND * dev
                kth = np.partition(low, -(k + 1), axis=1)[:, -(k + 1)] if len(x) > k + 1 else np.full(len(part_q), -np.inf)
                r, c = np.nonzero(est + BOUND * dev >= np.maximum(kth, min_similarity)[:, None])
                # The exact cosine is taken in double precision of the vectors as stored.
                exact = np.einsum("ij,ij->i", rq[start + r], rx[c]) / (nq[start + r] * nx[c])
                good = (exact >= min_similarity - 1e-9) & (hq[start + r] != hx[c])
                found.append(pd.DataFrame({"h": hq[start + r[good]], "g": hx[c[good]], "similarity": exact[good]}))
        if not found:
            return pd.DataFrame({"namespace": [], "h": [], "g": [], "similarity": []})
        out = pd.concat(found).sort_values(["h", "similarity"], ascending=[True, False], kind="stable")
        out = out[out.groupby("h").cumcount() <= k]
        out.insert(0, "namespace", key[0])
        return out

    pairs = spread.groupBy("namespace", "list", "qb", "ib").applyInPandas(compare, "namespace string, h long, g long, similarity double")
    best = Window.partitionBy("namespace", "h").orderBy(F.desc("similarity"), "g")
    near = pairs.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r")
    near = materialise(near, "knn-pairs")
    # Only the k + 1 smallest ids of a class can be answers; row_number with a bound is cut before the shuffle.
    first = Window.partitionBy("namespace", "h").orderBy("id")
    answers = member.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).select("namespace", F.col("h").alias("g"), F.col("id").alias("neighbour"))
    askers = member if queries is None else member.filter(queries)
    copies = askers.select("namespace", "h", "id").join(answers.withColumnRenamed("g", "h"), ["namespace", "h"]).filter("id <> neighbour").select("namespace", "id", "neighbour", F.lit(1.0).alias("similarity"))
    others = (near.join(answers, ["namespace", "g"]).select("namespace", "h", "neighbour", "similarity").join(askers, ["namespace", "h"])
              .select("namespace", "id", "neighbour", "similarity"))
    top = Window.partitionBy("namespace", "id").orderBy(F.desc("similarity"), "neighbour")
    return copies.unionByName(others).withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
