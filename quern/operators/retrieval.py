"""Answers in four modes, as rows of references in a total order.

The steps of one question are joins on tables of at most a few hundred rows
(hits, seeds, first neighbours) with the large indexes and the graph; the large
sides are read once and never collected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import graph, prompting
from quern.operators import vector_search as VS
from quern.operators.prompting import QueryParam


@dataclass
class Stores:
    """The tables a question is answered from.

    ``chunk_index, entity_index, relation_index``: ``id, vector`` and, for the last
    two, ``entity_id`` or ``src_id, tgt_id, keywords, description, source_ids``;
    ``chunks``: ``chunk_id, content``; ``entities``: ``name, type, description,
    source_ids`` with one row per name; ``relations``: the same for pairs ``a, b``.
    """

    chunks: DataFrame
    chunk_index: DataFrame | None = None
    entity_index: DataFrame | None = None
    relation_index: DataFrame | None = None
    entities: DataFrame | None = None
    relations: DataFrame | None = None


Embed = Callable[[str], list[float]]


def _queries(spark, texts: list[str], embed: Embed) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in embed(t)]) for i, t in enumerate(texts)], "query_id int, query_vector array<double>")


def ranked_hits(index: DataFrame, texts: list[str], embed: Embed, k: int) -> DataFrame:
    """Hits of all texts, each id once with its best score: ``id, score, r``."""
    hits = VS.dedup_hits(VS.top_k_batch(index, _queries(index.sparkSession, texts, embed), k))
    # At most k hits a text are left, so one task ranks them.
    return hits.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def _first_seen(parts: DataFrame) -> DataFrame:
    """``chunk_id, o``: distinct sources in the order first seen, from ``sources, o``."""
    return (parts.select("o", F.posexplode("sources").alias("p", "chunk_id")).filter("chunk_id <> ''").groupBy("chunk_id")
            .agg(F.min(F.struct("o", "p")).alias("o")))


def _number(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("ord", F.row_number().over(Window.orderBy(*order)))


def naive(s: Stores, question: str, embed: Embed, p: QueryParam) -> DataFrame:
    """``ord, chunk_id`` of the chunks most like the question."""
    hits = VS.top_k(s.chunk_index, embed(question), p.chunk_top_k)
    return _number(hits.select(F.col("id").alias("chunk_id"), "score"), F.desc("score"), "chunk_id").select("ord", "chunk_id")


def local_context(s: Stores, words: list[str], embed: Embed, p: QueryParam) -> tuple[DataFrame, DataFrame]:
    """Entities (``name, o``) and edges (``a, b, o``) around the entities most like the words."""
    hits = ranked_hits(s.entity_index, words, embed, p.top_k)
    named = hits.join(s.entity_index.select("id", "entity_id"), "id").select(F.coalesce(F.nullif("entity_id", F.lit("")), "id").alias("name"), "r")
    seeds = named.groupBy("name").agg(F.min("r").alias("r"))
    edges = s.relations.select("a", "b")
    near = graph.expand(edges, seeds, p.top_k).join(seeds.select(F.col("name").alias("seed"), "r"), "seed")
    nodes = near.groupBy("name").agg(F.min(F.struct("r", "pos")).alias("o"))
    # Edges induced per seed: both ends in the same neighbourhood.
    ends = near.select("seed", "r", "name")
    inside = (edges.join(ends.select("seed", "r", F.col("name").alias("a")), "a").join(ends.select("seed", F.col("name").alias("b")), ["seed", "b"])
              .groupBy("a", "b").agg(F.min("r").alias("r")))
    return nodes, inside.select("a", "b", F.struct("r", F.col("a").alias("x"), F.col("b").alias("y")).alias("o"))


def global_context(s: Stores, words: list[str], embed: Embed, p: QueryParam) -> tuple[DataFrame, DataFrame]:
    """Edges of the relations most like the words, and their ends that the graph has."""
    hits = ranked_hits(s.relation_index, words, embed, p.top_k)
    rows = hits.join(s.relation_index.drop("vector"), "id").filter(graph.valid_edge())
    # Of two hits for one pair the later one stays.
    edges = (rows.withColumn("a", F.least("src_id", "tgt_id")).withColumn("b", F.greatest("src_id", "tgt_id")).groupBy("a", "b")
             .agg(F.max_by(F.struct("src_id", "tgt_id", "keywords", "description", "source_ids", "r"), "r").alias("e")).select("a", "b", "e.*"))
    ends = edges.select(F.explode(F.array(F.struct("r", F.lit(0).alias("side"), F.col("src_id").alias("name")), F.struct("r", F.lit(1).alias("side"), F.col("tgt_id").alias("name")))).alias("x")).select("x.*")
    nodes = ends.groupBy("name").agg(F.min(F.struct("r", "side")).alias("o")).join(s.entities.select("name"), "name", "left_semi")
    return nodes, edges


def _local_chunks(s: Stores, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.join(s.entities, "name").select(F.struct(F.lit(0).alias("s"), F.col("o.r").alias("x"), F.col("o.pos").alias("y"), F.col("name").alias("z"), F.lit("").alias("w")).alias("o"), F.col("source_ids").alias("sources"))
    b = edges.join(s.relations, ["a", "b"]).select(F.struct(F.lit(1).alias("s"), F.col("o.r").alias("x"), F.lit(0).alias("y"), F.col("a").alias("z"), F.col("b").alias("w")).alias("o"), F.col("source_ids").alias("sources"))
    return _first_seen(a.unionByName(b))


def _global_chunks(s: Stores, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = edges.select(F.struct(F.lit(2).alias("s"), F.col("r").alias("x"), F.lit(0).alias("y"), F.col("a").alias("z"), F.col("b").alias("w")).alias("o"), F.col("source_ids").alias("sources"))
    b = nodes.join(s.entities, "name").select(F.struct(F.lit(3).alias("s"), F.col("o.r").alias("x"), F.col("o.side").alias("y"), F.col("name").alias("z"), F.lit("").alias("w")).alias("o"), F.col("source_ids").alias("sources"))
    return _first_seen(a.unionByName(b))


def _capped(chunks: DataFrame, k: int) -> DataFrame:
    return _number(chunks.orderBy("o").limit(k), "o").select("ord", "chunk_id")


def references(s: Stores, question: str, embed: Embed, param: QueryParam, high: list[str] | None = None, low: list[str] | None = None) -> DataFrame:
    """``ord, chunk_id``: the references of an answer, before missing contents are dropped.

    An empty keyword list is replaced by the question.
    """
    p = param.with_defaults()
    if not question.strip():
        raise ValueError("the question is empty")
    low, high = low or [question], high or [question]
    need = {"naive": ["chunk_index"], "local": ["entity_index", "entities", "relations"], "global": ["relation_index", "entities"],
            "hybrid": ["entity_index", "relation_index", "entities", "relations"]}
    if p.mode not in need:
        raise ValueError(f"unknown mode {p.mode!r}")
    for name in need[p.mode]:
        if getattr(s, name) is None:
            raise ValueError(f"mode {p.mode} needs {name}")
    if p.mode == "naive":
        return naive(s, question, embed, p)
    if p.mode == "local":
        return _capped(_local_chunks(s, *local_context(s, low, embed, p)), p.chunk_top_k)
    if p.mode == "global":
        return _capped(_global_chunks(s, *global_context(s, high, embed, p)), p.chunk_top_k)
    both = _local_chunks(s, *local_context(s, low, embed, p)).unionByName(_global_chunks(s, *global_context(s, high, embed, p)))
    return _capped(both.groupBy("chunk_id").agg(F.min("o").alias("o")), p.chunk_top_k)


def context_rows(s: Stores, refs: DataFrame) -> DataFrame:
    """``ord, chunk_id, content``: the references that have a content, in order."""
    return refs.join(s.chunks.select("chunk_id", "content"), "chunk_id").filter(~T.is_blank(F.col("content"))).select("ord", "chunk_id", "content")


def answer(s: Stores, question: str, embed: Embed, param: QueryParam, complete: Callable[[str], str], high: list[str] | None = None, low: list[str] | None = None) -> dict:
    """The reply with its references, those packed into the prompt, and the mode."""
    p = param.with_defaults()
    rows = context_rows(s, references(s, question, embed, p, high, low)).orderBy("ord").collect()  # at most chunk_top_k rows
    if not rows:
        return {"content": "Nothing relevant was found.", "references": [], "packed": [], "mode": p.mode}
    ents: list[str] = []
    rels: list[str] = []
    if p.mode in ("local", "hybrid"):
        nodes, edges = local_context(s, low or [question], embed, p)
        line = prompting.entity_line(F.col("name"), F.col("type"), F.col("description"))
        ents += [r["l"] for r in nodes.join(s.entities, "name").orderBy("o", "name").select(line.alias("l")).collect()]
        line = prompting.relation_line(F.col("a"), F.col("b"), F.col("keywords"), F.col("description"))
        rels += [r["l"] for r in edges.join(s.relations, ["a", "b"]).orderBy("o").select(line.alias("l")).collect()]
    if p.mode in ("global", "hybrid"):
        nodes, edges = global_context(s, high or [question], embed, p)
        line = prompting.entity_line(F.col("name"), F.col("type"), F.col("description"))
        ents += [r["l"] for r in nodes.join(s.entities, "name").orderBy("o", "name").select(line.alias("l")).collect()]
        line = prompting.relation_line(F.col("src_id"), F.col("tgt_id"), F.col("keywords"), F.col("description"))
        rels += [r["l"] for r in edges.orderBy("r").select(line.alias("l")).collect()]
    prompt, packed = prompting.assemble(question, list(dict.fromkeys(ents)), list(dict.fromkeys(rels)), [(r["chunk_id"], r["content"]) for r in rows], p)
    return {"content": complete(prompt), "references": [r["chunk_id"] for r in rows], "packed": packed, "mode": p.mode}


def insert(docs: DataFrame, doc_id: str, text: str, embed, chunks: DataFrame, index: DataFrame, namespace: str = "chunks") -> tuple[DataFrame, DataFrame]:
    """New states of the chunk table and the chunk index with the documents inserted.

    Documents are cut at paragraphs; all earlier chunks of a document are replaced,
    so none go stale.  ``embed`` is a Column function.
    """
    from quern.operators import chunking, store

    cut = chunking.by_paragraphs(docs, doc_id, text, 1200).select(
        T.chunk_id(F.col("id"), F.col("chunk_order_index")).alias("chunk_id"), F.col("id").cast("string").alias("doc_id"), "content", "tokens", "chunk_order_index")
    again = docs.select(F.col(doc_id).cast("string").alias("doc_id")).distinct()
    kept = store.delete(chunks, again, "doc_id")
    stale = chunks.join(again, "doc_id", "left_semi").select(F.col("chunk_id").alias("id"))
    vectors = cut.select(F.lit(namespace).alias("namespace"), F.col("chunk_id").alias("id"), embed(F.col("content")).cast("array<float>").alias("vector"))
    return kept.unionByName(cut, allowMissingColumns=True), store.delete(index, stale, "id").unionByName(vectors, allowMissingColumns=True)
