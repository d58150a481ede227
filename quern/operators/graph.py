"""Undirected graph on DataFrames: canonical edges, upkeep, degree and bounded search.

An edge is keyed by its ends in code-point order (``a < b``); empty ends and
self-loops are no edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import store
from quern.sources.tables import materialise


class InvalidEdge(ValueError):
    """An edge with an empty end or equal ends."""


class InvalidNode(ValueError):
    """A node without a name."""


def valid_edge(src: str = "src_id", tgt: str = "tgt_id"):
    s, t = F.coalesce(F.col(src), F.lit("")), F.coalesce(F.col(tgt), F.lit(""))
    return (s != "") & (t != "") & (s != t)


def keyed(relations: DataFrame, strict: bool = False) -> DataFrame:
    """Adds the canonical ends ``a, b``; invalid edges are dropped, or raise in strict mode."""
    if strict and relations.filter(~valid_edge()).limit(1).count():
        raise InvalidEdge("an edge has an empty end or equal ends")
    return relations.filter(valid_edge()).withColumn("a", F.least("src_id", "tgt_id")).withColumn("b", F.greatest("src_id", "tgt_id"))


def edge_set(relations: DataFrame) -> DataFrame:
    """Distinct canonical edges ``a, b``."""
    return keyed(relations.select("src_id", "tgt_id")).select("a", "b").distinct()


def upsert_edges(edges: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """Replaces edges by their canonical key; the writer's direction stays in the row."""
    key = F.struct(F.least("src_id", "tgt_id").alias("a"), F.greatest("src_id", "tgt_id").alias("b"))
    old, fresh = (df.filter(valid_edge()).withColumn("_key", key) for df in (edges, new))
    return store.upsert(old, fresh, "_key", *order).drop("_key")


def with_endpoints(nodes: DataFrame, edges: DataFrame, name: str = "name") -> DataFrame:
    """The nodes and, with nulls for all else, every end of an edge that is not among them."""
    ends = edges.select(F.explode(F.array("a", "b")).alias(name)).distinct()
    missing = ends.join(nodes.select(name), name, "left_anti")
    return nodes.unionByName(missing, allowMissingColumns=True)


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: ``v, n``."""
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("n")), F.struct(F.col("b").alias("v"), F.col("a").alias("n")))).alias("e")).select("e.v", "e.n")


def degree(edges: DataFrame, nodes: DataFrame | None = None, name: str = "name") -> DataFrame:
    """Number of distinct neighbours of each node; with ``nodes``, 0 for those without."""
    counted = edges.select(F.explode(F.array("a", "b")).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("degree"))
    if nodes is None:
        return counted
    return nodes.select(name).distinct().join(counted, name, "left").select(name, F.coalesce("degree", F.lit(0)).alias("degree"))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """Neighbours of one node in order."""
    return adjacency(edges).filter(F.col("v") == node).select(F.col("n").alias("name")).orderBy("name")


def is_truncated(edges: DataFrame, found: DataFrame, max_depth: int) -> bool:
    """Whether a search left out nodes it could reach within its depth: some node short of the depth has a neighbour outside."""
    inner = found.filter(F.col("depth") < max_depth).select(F.col("name").alias("v"))
    outside = adjacency(edges).join(inner, "v", "left_semi").select(F.col("n").alias("name")).join(found.select("name"), "name", "left_anti")
    return not outside.isEmpty()


def check_nodes(nodes: DataFrame, name: str = "name") -> DataFrame:
    """The nodes; raises if one has no name."""
    if not nodes.filter(F.coalesce(F.col(name), F.lit("")) == "").isEmpty():
        raise InvalidNode("a node has no name")
    return nodes


def search(edges: DataFrame, seed: str, max_depth: int, max_nodes: int) -> DataFrame:
    """Level-wise search from a seed: ``name, depth, pos`` of the admitted nodes.

    All candidates of a level are ranked by degree, then name, and admitted until
    ``max_nodes`` are held.  A level never holds more than ``max_nodes`` rows, so
    frontiers are small; the edges are read once per level and never moved.
    """
    spark = edges.sparkSession
    if max_nodes <= 0 or max_depth < 0 or not seed:
        return spark.createDataFrame([], "name string, depth int, pos int")
    # Degrees are counted once, not at every level.
    both, degrees = adjacency(edges), materialise(degree(edges), "graph-degrees")
    if degrees.filter(F.col("name") == seed).limit(1).count() == 0:
        return spark.createDataFrame([], "name string, depth int, pos int")
    held = [(seed, 0, 0)]
    frontier = [seed]
    for depth in range(1, max_depth + 1):
        room = max_nodes - len(held)
        if room <= 0 or not frontier:
            break
        # Both small sides have at most max_nodes rows.
        front = F.broadcast(spark.createDataFrame([(v,) for v in frontier], "v string"))
        seen = F.broadcast(spark.createDataFrame([(v,) for v, _, _ in held], "name string"))
        level = both.join(front, "v").select(F.col("n").alias("name")).distinct().join(seen, "name", "left_anti")
        admitted = level.join(degrees, "name").orderBy(F.desc("degree"), "name").limit(room).collect()
        frontier = [r["name"] for r in admitted]
        held += [(v, depth, len(held) + i) for i, v in enumerate(frontier)]
    return spark.createDataFrame(held, "name string, depth int, pos int")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("name").alias("a")), "a", "left_semi").join(nodes.select(F.col("name").alias("b")), "b", "left_semi").select("a", "b")


def expand(edges: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """One-hop neighbourhoods of many seeds at once: ``seed, name, pos``.

    Position 0 is the seed, then its neighbours by degree and name, at most
    ``limit`` nodes in all; seeds that the graph lacks give nothing.
    """
    wanted = seeds.select(F.col("name").alias("v")).distinct()
    reached = adjacency(edges).join(wanted, "v").join(degree(edges), F.col("n") == F.col("name")).select(F.col("v").alias("seed"), F.col("n").alias("name"), "degree")
    rank = Window.partitionBy("seed").orderBy(F.desc("degree"), "name")
    near = reached.withColumn("pos", F.row_number().over(rank)).filter(F.col("pos") <= limit - 1).select("seed", "name", "pos")
    own = adjacency(edges).join(wanted, "v", "left_semi").select(F.col("v").alias("seed"), F.col("v").alias("name"), F.lit(0).alias("pos")).distinct()
    return own.unionByName(near) if limit > 0 else own.limit(0)


def top_nodes(edges: DataFrame, n: int) -> DataFrame:
    """The nodes of highest degree: the start of a search without a seed."""
    return degree(edges).orderBy(F.desc("degree"), "name").limit(max(n, 0))


def compact(edges: DataFrame) -> DataFrame:
    """The edge set written once, for repeated searches."""
    return materialise(edges, "graph-edges")
