"""Queries over vectors, graph, extraction, merging, keywords and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import embed, jsontext
from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import docstatus, extraction, graph, merging, prompting, store
from quern.operators import vector_search as VS
from quern.plans import sqltext as S
from quern.plans.documents import chunks_now
from quern.sources.tables import table
from quern.streaming.ingest import windowed_counts

def _components(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    return df.select(key, *[F.round(F.get(vector, F.lit(i)), 6).alias(f"v{i}") for i in range(dim)])


def embed_tiled(spark: SparkSession, d: str) -> DataFrame:
    """Tiled hash embedding of every chunk, 8 components."""
    return _components(chunks_now(spark, d).filter("content is not null").withColumn("v", embed.tiled(F.col("content"), 8)), "chunk_id", "v", 8)


def embed_counter(spark: SparkSession, d: str) -> DataFrame:
    """Counter-stretched hash embedding of every chunk, 40 components; the first, the last and two at the seam."""
    v = chunks_now(spark, d).filter("content is not null").withColumn("v", embed.counter(F.col("content"), 40))
    return v.select("chunk_id", *[F.round(F.get("v", F.lit(i)), 6).alias(f"v{i}") for i in (0, 31, 32, 39)])


def embed_words(spark: SparkSession, d: str) -> DataFrame:
    """Bag-of-words hash embedding of every distinct mention text, 8 components."""
    text = embed.entity_text(F.col("name"), F.col("description"))
    rows = store.latest(table(spark, d, "entities"), "mention_id", "extracted_at").select("mention_id", text.alias("t"))
    return _components(rows.withColumn("v", embed.words(F.col("t"), 8)), "mention_id", "v", 8)


def _index(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(table(spark, d, "vector_index"), "id", "ingested_at")


def vec_norm(spark: SparkSession, d: str) -> DataFrame:
    """Stored and computed length of every vector."""
    return _index(spark, d).select("namespace", "id", F.round("norm", 5).alias("stored"), F.round(V.norm(F.col("vector")), 5).alias("computed"))


def vec_usable(spark: SparkSession, d: str) -> DataFrame:
    """Vectors per namespace by whether they can be searched."""
    dim = VS.dimension(table(spark, d, "vector_index"))
    return _index(spark, d).groupBy("namespace", VS.usable(F.col("vector"), dim or 0).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def vec_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each embedding with the next one."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()["embedding"])


def vec_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten embeddings most like the first."""
    out = VS.top_k(table(spark, d, "embeddings"), _first_vector(spark, d), 10, "vec_id", "embedding")
    return out.select("vec_id", F.round("score", 6).alias("score"))


def vec_topk_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Those of at least 0.3 among the fifty most like the first."""
    out = VS.top_k(table(spark, d, "embeddings"), _first_vector(spark, d), 50, "vec_id", "embedding", threshold=0.3)
    return out.select("vec_id", F.round("score", 6).alias("score"))


def _label_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query_vector")).withColumnRenamed("label", "query_id")


def vec_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    """The five embeddings most like the first of each label."""
    out = VS.top_k_batch(table(spark, d, "embeddings"), _label_queries(spark, d), 5, "vec_id", "embedding")
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def vec_dedup_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of all label queries, each id with its best score."""
    out = VS.dedup_hits(VS.top_k_batch(table(spark, d, "embeddings"), _label_queries(spark, d), 50, "vec_id", "embedding"), "vec_id")
    return out.select("vec_id", F.round("score", 6).alias("score"))


def vec_upsert(spark: SparkSession, d: str) -> DataFrame:
    """All deliveries of usable vectors written into an empty index."""
    rows = table(spark, d, "vector_index").filter(F.size("vector") == 128)
    out = VS.upsert(rows.limit(0), rows, order="ingested_at")
    return out.select("namespace", "id", "ingested_at")


def vec_delete(spark: SparkSession, d: str) -> DataFrame:
    """The index without the chunks of failed documents."""
    failed = docstatus.by_status(docstatus.current(table(spark, d, "doc_status")), "failed").select(F.explode("chunks_list").alias("id")).distinct()
    return store.delete(_index(spark, d), failed, "id").select("namespace", "id")


def _relations(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(table(spark, d, "relations"), "rel_id", "extracted_at")


def graph_canonical_edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct undirected edges with the number of relations on each."""
    return graph.keyed(_relations(spark, d)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_relations"))


def graph_upsert_edges(spark: SparkSession, d: str) -> DataFrame:
    """Relations written in order into an empty graph: the last of each pair stays."""
    rows = _relations(spark, d)
    out = graph.upsert_edges(rows.limit(0), rows, "extracted_at", "rel_id")
    return out.select("src_id", "tgt_id", "rel_id")


def graph_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Ends of edges that no mention as a person declares."""
    edges = graph.edge_set(table(spark, d, "relations"))
    nodes = table(spark, d, "entities").filter("name <> '' and lower(type) = 'person'").select("name").distinct().withColumn("declared", F.lit(True))
    return graph.with_endpoints(nodes, edges).filter("declared is null").select("name")


def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    """Degree of every mentioned name; 0 without edges."""
    nodes = table(spark, d, "entities").select("name").filter("name <> ''")
    return graph.degree(graph.edge_set(table(spark, d, "relations")), nodes)


def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Every node with every neighbour."""
    return graph.adjacency(graph.edge_set(table(spark, d, "relations"))).select(F.col("v").alias("name"), F.col("n").alias("neighbour"))


def _bfs(spark: SparkSession, d: str, depth: int) -> DataFrame:
    edges = graph.compact(graph.edge_set(table(spark, d, "relations")))
    return graph.search(edges, graph.top_nodes(edges, 1).first()["name"], depth, 60)


def graph_bfs_d1(spark: SparkSession, d: str) -> DataFrame:
    """At most 60 nodes within one step of the hub."""
    return _bfs(spark, d, 1)


def graph_bfs_d2(spark: SparkSession, d: str) -> DataFrame:
    """At most 60 nodes within two steps of a node of low degree, by degree."""
    edges = graph.compact(graph.edge_set(table(spark, d, "relations")))
    seed = graph.degree(edges).orderBy("degree", "name").first()["name"]
    return graph.search(edges, seed, 2, 60)


def graph_induced(spark: SparkSession, d: str) -> DataFrame:
    """Edges among the nodes within one step of the hub."""
    edges = graph.compact(graph.edge_set(table(spark, d, "relations")))
    return graph.induced(edges, graph.search(edges, graph.top_nodes(edges, 1).first()["name"], 1, 60))


def graph_expand_hits(spark: SparkSession, d: str) -> DataFrame:
    """One-hop neighbourhoods of the names of the entity index, ten nodes each."""
    names = _index(spark, d).filter("namespace = 'entities'").select(F.get_json_object("metadata", "$.entity_id").alias("name")).filter("name is not null")
    return graph.expand(graph.edge_set(table(spark, d, "relations")), names, 10)


def graph_top_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The 20 nodes of highest degree."""
    return graph.top_nodes(graph.edge_set(table(spark, d, "relations")), 20)


def _replies(spark: SparkSession, d: str, *stages: str) -> DataFrame:
    return store.latest(table(spark, d, "llm_responses").filter(F.col("stage").isin(*stages)), "response_id", "finished_at")


def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of all extraction replies."""
    return extraction.entities(extraction.records(_replies(spark, d, "extract", "glean"), "response_id", "text")).withColumnRenamed("id", "response_id")


def extract_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations of all extraction replies."""
    return extraction.relations(extraction.records(_replies(spark, d, "extract", "glean"), "response_id", "text")).withColumnRenamed("id", "response_id")


def extract_cache_key(spark: SparkSession, d: str) -> DataFrame:
    """Cache key of every chunk."""
    return chunks_now(spark, d).select("chunk_id", T.cache_key(F.col("content")).alias("cache_key"))


def extract_cache_split(spark: SparkSession, d: str) -> DataFrame:
    """Chunks found and not found in a cache of the contents of processed documents."""
    chunks = chunks_now(spark, d)
    done = docstatus.by_status(docstatus.current(table(spark, d, "doc_status")), "processed").select("doc_id")
    cache = chunks.join(done, "doc_id", "left_semi").filter("content is not null").select(T.cache_key(F.col("content")).alias("cache_key"), F.lit("").alias("raw")).distinct()
    hits, misses = extraction.split_by_cache(chunks.filter("content is not null"), cache)
    return hits.select("chunk_id", F.lit("hit").alias("state")).unionByName(misses.select("chunk_id", F.lit("miss").alias("state")))


def extract_glean(spark: SparkSession, d: str) -> DataFrame:
    """Names per source: those of the extract replies, then those only the glean replies have."""
    def named(stage: str) -> DataFrame:
        rows = _replies(spark, d, stage)
        parsed = extraction.entities(extraction.records(rows, "response_id", "text"))
        return parsed.join(rows.select(F.col("response_id").alias("id"), "source"), "id").select(F.col("source").alias("id"), "name", "type", "description")

    out = extraction.glean(named("extract"), lambda active, n: named("glean"), 1)
    return out.groupBy("id", "round").agg(F.countDistinct("name").alias("n_names")).withColumnRenamed("id", "source")


def _first_words(texts: Column) -> Column:
    """A stand-in for a summary: the first ten words of the first text."""
    return T.truncate_tokens(F.get(texts, F.lit(0)), 10)


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(table(spark, d, "entities"), "mention_id", "extracted_at")


def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    """Mentions merged by name, descriptions joined or summarised in windows of 200 tokens by the stand-in."""
    return merging.merge_entities(_mentions(spark, d), ["extracted_at", "mention_id"], reduce=_first_words, context=200).withColumn("description", F.md5("description"))


def merge_entity_sources(spark: SparkSession, d: str) -> DataFrame:
    """The merged source ids of every name, in segments of 100, each as one checksum."""
    out = merging.entity_sources(_mentions(spark, d), segment=100)
    return out.select("name", "segment_no", "n_elements", F.md5(F.array_join("elements", "|")).alias("elements_md5"))


def merge_relation_sources(spark: SparkSession, d: str) -> DataFrame:
    """The merged source ids of every undirected pair, in segments of 100, each as one checksum."""
    out = merging.relation_sources(_relations(spark, d), segment=100)
    return out.select("src_id", "tgt_id", "segment_no", "n_elements", F.md5(F.array_join("elements", "|")).alias("elements_md5"))


def merge_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations merged by undirected pair, descriptions as in `merge_entities`."""
    out = merging.merge_relations(_relations(spark, d), ["extracted_at", "rel_id"], reduce=_first_words, context=200)
    return out.withColumn("weight", F.round("weight", 2)).withColumn("description", F.md5("description"))


def summarize_windows(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of every name packed into windows of 200 tokens."""
    out = merging.windows(_mentions(spark, d), "name", "description", ["extracted_at", "mention_id"], 200)
    return out.select("name", "block_no", "window_no", F.size("texts").alias("n_texts"), F.aggregate("texts", F.lit(0), lambda s, t: s + T.token_count(t)).alias("n_tokens"))


def summarize_full(spark: SparkSession, d: str) -> DataFrame:
    """A summary of every name by a stand-in that keeps the first ten words of the first text."""
    return merging.summarise(_mentions(spark, d), "name", "description", ["extracted_at", "mention_id"], _first_words, context=200)


def keywords_parse(spark: SparkSession, d: str) -> DataFrame:
    """Keyword lists of all keyword replies; empty where the reply cannot be read."""
    k = _replies(spark, d, "keywords").filter("text is not null").select("response_id", jsontext.keywords(F.col("text")).alias("k"))
    return k.select("response_id", F.array_join("k.high", "|").alias("high"), F.array_join("k.low", "|").alias("low"))


def keywords_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Low-level keywords, or the last user message where there are none."""
    asked = table(spark, d, "llm_requests").select("request_id", F.element_at("messages", -1)["content"].alias("query"))
    rows = _replies(spark, d, "keywords").join(asked, "request_id")
    low = jsontext.or_query(jsontext.keywords(F.coalesce("text", F.lit("")))["low"], F.col("query"))
    return rows.select("response_id", F.array_join(low, "|").alias("low"))


def render_entities(spark: SparkSession, d: str) -> DataFrame:
    """Context line of every mention."""
    rows = store.latest(table(spark, d, "entities"), "mention_id", "extracted_at").filter("name is not null")
    return rows.select("mention_id", prompting.entity_line(F.col("name"), F.col("type"), F.col("description")).alias("line"))


def render_relations(spark: SparkSession, d: str) -> DataFrame:
    """Context line of every relation."""
    rows = _relations(spark, d).filter("src_id is not null and tgt_id is not null")
    return rows.select("rel_id", prompting.relation_line(F.col("src_id"), F.col("tgt_id"), F.col("keywords"), F.col("description")).alias("line"))


def pack_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each document that fit into 300 tokens, in order."""
    rows = chunks_now(spark, d).select("chunk_id", "doc_id", T.token_count(F.col("content")).alias("n_tokens"), F.struct(F.coalesce("chunk_order_index", F.lit(-1)).alias("i"), "chunk_id").alias("pos"))
    return prompting.pack_rows(rows, 300, ["doc_id"], "pos", "n_tokens").select("doc_id", "chunk_id", "n_tokens")


def hybrid_chunk_union(spark: SparkSession, d: str) -> DataFrame:
    """Sources per name: those of mentions first, then unseen ones of its relations."""
    local = table(spark, d, "entities").select("name", F.explode("source_ids").alias("chunk_id"), F.lit(0).alias("side"))
    other = table(spark, d, "relations").select(F.col("src_id").alias("name"), F.explode("source_ids").alias("chunk_id"), F.lit(1).alias("side"))
    both = local.unionByName(other).filter("name <> '' and chunk_id <> ''")
    return both.groupBy("name", "chunk_id").agg(F.min("side").alias("side")).groupBy("name").agg(
        F.count_if(F.col("side") == 0).alias("n_local"), F.count_if(F.col("side") == 1).alias("n_added"))


def entity_union(spark: SparkSession, d: str) -> DataFrame:
    """Names of mentions and of relation ends: where both have one, that of the relation wins."""
    local = table(spark, d, "entities").select("name").filter("name <> ''").distinct().withColumn("side", F.lit("local"))
    glob = table(spark, d, "relations").select(F.explode(F.array("src_id", "tgt_id")).alias("name")).filter("name <> ''").distinct().withColumn("side", F.lit("global"))
    return store.upsert(local, glob, "name").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def llm_usage(spark: SparkSession, d: str) -> DataFrame:
    """Token totals per model, requests without a reply included."""
    replies = store.latest(table(spark, d, "llm_responses").select("response_id", "request_id", "input_tokens", "output_tokens", "finished_at"), "response_id", "finished_at")
    joined = table(spark, d, "llm_requests").select("request_id", "model").join(replies.select("request_id", "response_id", "input_tokens", "output_tokens"), "request_id", "left")
    return joined.groupBy("model").agg(F.countDistinct("request_id").alias("n_requests"), F.count("response_id").alias("n_responses"),
                                       F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def vec_cosine_shorter(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of the first 20 components of each embedding with the next one, over the components both have."""
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 20).alias("e"))
    nxt = table(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(V.cosine_shorter(F.col("e"), F.col("other")), 6).alias("score"))


def vec_random_unit(spark: SparkSession, d: str) -> DataFrame:
    """A random direction for every embedding's id: its size and length."""
    e = table(spark, d, "embeddings").select("vec_id", V.random_unit(F.col("vec_id"), 16).alias("v"))
    return e.select("vec_id", F.size("v").alias("dim"), F.round(V.norm(F.col("v")), 6).alias("length"))


def extract_cache_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Share of the chunks that a cache of the contents of processed documents has."""
    split = extract_cache_split(spark, d)
    out = extraction.cache_ratio(split.filter("state = 'hit'"), split.filter("state = 'miss'"))
    return out.withColumn("ratio", F.round("ratio", 6))


def keywords_ask(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of the questions of all keyword requests, answered by the stored replies."""
    replies = _replies(spark, d, "keywords").groupBy("request_id").agg(F.max("text").alias("text"))
    asked = table(spark, d, "llm_requests").select("request_id", F.element_at("messages", -1)["content"].alias("question"))
    out = prompting.ask_keywords(asked, lambda prompts: prompts.select("request_id").join(replies, "request_id"), "request_id", "question")
    return out.select("request_id", F.array_join("high", "|").alias("high"), F.array_join("low", "|").alias("low"))


def graph_truncated(spark: SparkSession, d: str) -> DataFrame:
    """Whether the search from the hub left out nodes within its depth."""
    edges = graph.compact(graph.edge_set(table(spark, d, "relations")))
    found = graph.search(edges, graph.top_nodes(edges, 1).first()["name"], 1, 60)
    return spark.createDataFrame([(found.count(), graph.is_truncated(edges, found, 1))], "n_nodes long, truncated boolean")


def render_lists(spark: SparkSession, d: str) -> DataFrame:
    """Source ids of every mention as one JSON list, and a preview of its description."""
    rows = _mentions(spark, d).filter("source_ids is not null")
    return rows.select("mention_id", jsontext.quote_list(F.col("source_ids")).alias("ids"), T.one_line(F.coalesce("description", F.lit("")), 20).alias("preview"))


def content_of_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first content column that is not empty, for every chunk."""
    rows = chunks_now(spark, d).select("chunk_id", F.lit("").alias("content"), F.col("content").alias("text"))
    return rows.select("chunk_id", F.md5(prompting.text_content(rows)).alias("content_md5"))


def summarize_fast(spark: SparkSession, d: str) -> DataFrame:
    """Names whose descriptions are joined as they are, and how long the result is."""
    rows = _mentions(spark, d).filter("name <> ''")
    counted = rows.groupBy("name").agg(F.count_if(F.col("description") != "").alias("n_descriptions"))
    out = counted.join(merging.unsummarised(rows, "name", "description", ["extracted_at", "mention_id"]), "name", "left").filter("n_descriptions = 0 or description is not null")
    return out.select("name", "n_descriptions", T.token_count(F.col("description")).alias("n_tokens"))


def description_lines(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of every relation pair as JSON lines, in blocks of 50 by description."""
    parts = _description_blocks(spark, d, 50)
    return parts.select("a", "b", "block_no", F.size("parts").alias("n_descriptions"), F.md5(jsontext.json_lines(F.col("parts"))).alias("lines_md5"))


def description_line_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of every relation pair as JSON lines, pairs of many relations in several rows of bounded size."""
    return _description_blocks(spark, d).select("a", "b", "block_no", F.size("parts").alias("n_descriptions"), jsontext.json_lines(F.col("parts")).alias("lines"))


def _description_blocks(spark: SparkSession, d: str, block: int = merging.BLOCK) -> DataFrame:
    rows = graph.keyed(_relations(spark, d)).filter("description <> ''").withColumn("pair", F.to_json(F.struct("a", "b")))
    parts = merging.blocks(rows, "pair", "description", ["description", "rel_id"], block)
    return parts.withColumn("k", F.from_json("pair", "a string, b string")).select("k.a", "k.b", "block_no", "parts")


def graph_upsert_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Mentions written in order into an empty node table: the last of each name stays."""
    rows = store.latest(table(spark, d, "entities"), "mention_id", "extracted_at").filter("name <> ''")
    out = store.upsert(rows.limit(0), rows, "name", "extracted_at", "mention_id")
    return out.select("name", "mention_id", "type")


def events_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Events per kind and hour: the streaming aggregate over the whole table."""
    out = windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def vector_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Dimension and first components of every embedding."""
    e = table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("dim"), F.slice("embedding", 1, 6).alias("h"))
    return e.select("vec_id", "dim", F.round(F.aggregate("h", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("head_sum"))


QUERIES = {f.__name__: f for f in (
    vec_cosine_shorter, vec_random_unit, extract_cache_ratio, keywords_ask, graph_truncated, render_lists, content_of_rows, summarize_fast, description_lines, description_line_blocks, graph_upsert_nodes, events_hourly, vector_manifest, embed_tiled, embed_counter, embed_words, vec_norm, vec_usable, vec_cosine, vec_topk, vec_topk_threshold, vec_topk_batch, vec_dedup_hits, vec_upsert, vec_delete,
    graph_canonical_edges, graph_upsert_edges, graph_endpoints, graph_degree, graph_neighbors, graph_bfs_d1, graph_bfs_d2, graph_induced, graph_expand_hits, graph_top_nodes,
    extract_entities, extract_relations, extract_cache_key, extract_cache_split, extract_glean, merge_entities, merge_relations, merge_entity_sources, merge_relation_sources, summarize_windows, summarize_full,
    keywords_parse, keywords_fallback, render_entities, render_relations, pack_chunks, hybrid_chunk_union, entity_union, llm_usage)}

_MENTIONS = S.deliveries("entities", "mention_id", "name, type, description, source_ids, extracted_at", "extracted_at DESC")
_RELATIONS = S.deliveries("relations", "rel_id", "src_id, tgt_id, keywords, description, weight, source_ids, extracted_at", "extracted_at DESC")
_REPLIES = S.deliveries("llm_responses", "response_id", "request_id, source, stage, text, input_tokens, output_tokens", "finished_at DESC")
_VALID_EDGE = "coalesce(src_id, '') <> '' AND coalesce(tgt_id, '') <> '' AND src_id <> tgt_id"
_EDGES = f"(SELECT DISTINCT least(src_id, tgt_id) AS a, greatest(src_id, tgt_id) AS b FROM relations WHERE {_VALID_EDGE})"
_ADJ = f"(SELECT a AS v, b AS n FROM {_EDGES} UNION ALL SELECT b, a FROM {_EDGES})"
_DEG = f"(SELECT v AS name, count(*) AS degree FROM {_ADJ} GROUP BY 1)"


def _hash_vector(text: str, dim: int, name: str = "v") -> str:
    """Normalised components from a list of raw ones."""
    return f"list_transform({text}, lambda x: x / sqrt(list_sum(list_transform({text}, lambda y: y * y))))"


def _list(v: str, i: int) -> str:
    return f"round({v}[{i + 1}], 6) AS v{i}"


_TILED = "list_transform(range(8), lambda i: (CAST('0x' || substr(sha256(content), i * 2 + 1, 2) AS BIGINT) - 127.5::DOUBLE) / 127.5::DOUBLE)"
_COUNTER_HEX = "sha256(encode(content) || unhex('00000000')) || sha256(encode(content) || unhex('00000001'))"
_LINES = f"""(SELECT response_id, j - 1 AS line_no, regexp_replace(regexp_replace({S.trimmed('l')}, '^[()"'' \\t]+', ''), '[()"'' \\t]+$', '') AS l FROM (
    SELECT response_id, unnest(p) AS l, generate_subscripts(p, 1) AS j FROM (
      SELECT response_id, string_split(replace(replace(text, '<|COMPLETE|>', ''), '<|complete|>', ''), chr(10)) AS p FROM {_REPLIES} WHERE stage IN ('extract', 'glean')))
    WHERE contains(l, '<|#|>'))"""
_RECORDS = f"""(SELECT *, lower(regexp_replace(regexp_replace(trim(f[1], ' '), '^[()"'' \\t]+', ''), '[()"'' \\t]+$', '')) AS kind
    FROM (SELECT response_id, CAST(line_no AS INT) AS line_no, string_split(l, '<|#|>') AS f FROM {_LINES}) WHERE len(f) >= 2)"""


def _p(i: int) -> str:
    return f"trim({S.trimmed(f'f[{i + 1}]')}, '\"''')"


_ENTITIES = f"(SELECT response_id, line_no, {_p(1)} AS name, lower({_p(2)}) AS type, {_p(3)} AS description FROM {_RECORDS} WHERE contains(kind, 'entity') AND len(f) >= 4 AND {_p(1)} <> '')"


def _fits(budget: int = 500) -> str:
    return f"(n = 1 OR (n < 6 AND tk < {budget}))"


def _packed(name: str, rows: str, budget: int) -> str:
    """Windows of at most ``budget`` fields over ``rows`` (k, t, tok, rn): a text that does not fit opens the next, but joins a window of one text and closes it."""
    return f"""{name}_p AS (SELECT k, t, tok, rn // 1000 AS block_no, rn % 1000 AS pos FROM {rows}),
      {name} AS (SELECT k, t, tok, block_no, pos, 0 AS window_no, CAST(tok AS BIGINT) AS used, 1 AS cnt, false AS closed FROM {name}_p WHERE pos = 0
        UNION ALL SELECT p.k, p.t, p.tok, p.block_no, p.pos,
          CASE WHEN w.closed OR (w.used + p.tok > {budget} AND w.cnt > 1) THEN w.window_no + 1 ELSE w.window_no END,
          CASE WHEN w.closed OR (w.used + p.tok > {budget} AND w.cnt > 1) THEN p.tok ELSE w.used + p.tok END,
          CASE WHEN w.closed OR (w.used + p.tok > {budget} AND w.cnt > 1) THEN 1 ELSE w.cnt + 1 END,
          NOT w.closed AND w.used + p.tok > {budget} AND w.cnt = 1
        FROM {name} w JOIN {name}_p p ON p.k = w.k AND p.block_no = w.block_no AND p.pos = w.pos + 1)"""


_TEN = f"CASE WHEN len({S.fields('t')}) <= 10 THEN t ELSE array_to_string({S.fields('t')}[1:10], ' ') END"


def _summaries(rows: str, context: int = 200, depth: int = 3) -> str:
    """CTEs that end in ``summed`` (k, description, llm_used) over ``rows`` (k, t, rn): rounds of windows, each reduced to the first ten words of its first text."""
    parts = [f"l0 AS (SELECT k, t, len({S.fields('t')}) AS tok, rn FROM {rows})"]
    for i in range(depth + 1):
        parts += [f"s{i} AS (SELECT k, count(*) AS n, sum(tok) AS tk FROM l{i} GROUP BY 1)",
                  f"d{i} AS (SELECT k, string_agg(t, chr(10) || chr(10) ORDER BY rn) AS description, {'true' if i else 'false'} AS llm_used FROM l{i} JOIN s{i} USING (k) WHERE {_fits()} GROUP BY 1)",
                  f"r{i} AS (SELECT l{i}.* FROM l{i} JOIN s{i} USING (k) WHERE NOT {_fits()})"]
        if i < depth:
            parts += [_packed(f"w{i}", f"r{i}", context),
                      f"g{i} AS (SELECT k, block_no, window_no, arg_min(t, pos) AS t, count(*) AS c FROM w{i} GROUP BY 1, 2, 3)",
                      f"""l{i + 1} AS (SELECT k, t, len({S.fields('t')}) AS tok, row_number() OVER (PARTITION BY k ORDER BY block_no, window_no) - 1 AS rn
                        FROM (SELECT k, block_no, window_no, CASE WHEN c > 1 THEN {_TEN} ELSE t END AS t FROM g{i}))"""]
    done = " UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(depth + 1))
    parts.append(f"summed AS ({done} UNION ALL SELECT k, {_TEN}, true FROM r{depth} WHERE rn = 0)")
    return ", ".join(parts)


_NAMED = f"(SELECT name AS k, description AS t, row_number() OVER (PARTITION BY name ORDER BY extracted_at NULLS FIRST, mention_id) - 1 AS rn FROM {_MENTIONS} WHERE name <> '' AND description <> '')"
_LINES_OF = """string_agg('{"Description":' || to_json(description) || '}', chr(10) ORDER BY description, rel_id)"""
_PAIR_BLOCKS = f"""(SELECT a, b, description, rel_id, CAST((row_number() OVER (PARTITION BY a, b ORDER BY description, rel_id) - 1) // {{size}} AS INT) AS block_no
  FROM (SELECT least(src_id, tgt_id) AS a, greatest(src_id, tgt_id) AS b, description, rel_id FROM {_RELATIONS} WHERE {_VALID_EDGE} AND description <> ''))"""
_FIRST_OBJECT = r"regexp_extract(text, '\{[^{}]*\}')"


def _keyword_list(key: str) -> str:
    return f"""coalesce(CASE WHEN json_valid(o) THEN array_to_string(list_filter(list_transform(json_extract_string(o, '$.{key}[*]'), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') END, '')"""


_LABELS = "(SELECT label AS query_id, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY 1)"
_COS = "list_cosine_similarity(embedding::DOUBLE[], {q}::DOUBLE[])"
_FIRST = "(SELECT arg_min(embedding, vec_id) FROM embeddings)"
_BATCH = f"SELECT query_id, vec_id, {_COS.format(q='q')} AS s, row_number() OVER (PARTITION BY query_id ORDER BY {_COS.format(q='q')} DESC, vec_id) AS rank FROM embeddings, {_LABELS}"


def _search(seed: str, depth: int) -> str:
    sql = f"""WITH adj AS {_ADJ}, deg AS {_DEG}, seed AS (SELECT {seed} AS name),
      l0 AS (SELECT name, 0 AS depth, CAST(0 AS BIGINT) AS pos FROM seed WHERE name IN (SELECT name FROM deg)),
      c1 AS (SELECT DISTINCT n AS name FROM adj JOIN l0 ON v = l0.name WHERE n NOT IN (SELECT name FROM l0)),
      l1 AS (SELECT * FROM (SELECT name, 1 AS depth, row_number() OVER (ORDER BY degree DESC, name) AS pos FROM c1 JOIN deg USING (name)) WHERE pos < 60)"""
    if depth == 1:
        return sql + ", r AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1)"
    return sql + """, c2 AS (SELECT DISTINCT n AS name FROM adj JOIN l1 ON v = l1.name WHERE n NOT IN (SELECT name FROM l0) AND n NOT IN (SELECT name FROM l1)),
      l2 AS (SELECT name, 2 AS depth, row_number() OVER (ORDER BY degree DESC, name) + (SELECT count(*) FROM l1) AS pos FROM c2 JOIN deg USING (name)),
      r AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 WHERE pos < 60)"""


_TOP = "(SELECT name FROM deg ORDER BY degree DESC, name LIMIT 1)"
_ROWS = " SELECT name, depth, CAST(pos AS INT) AS pos FROM r"

SQL = {
    "vec_cosine_shorter": "SELECT e.vec_id, round(list_cosine_similarity(e.embedding[1:20]::DOUBLE[], o.embedding[1:20]::DOUBLE[]), 6) AS score FROM embeddings e JOIN embeddings o ON o.vec_id = e.vec_id + 1",
    "vec_random_unit": "SELECT vec_id, CAST(16 AS INT) AS dim, 1.0::DOUBLE AS length FROM embeddings",
    "extract_cache_ratio": f"""WITH c AS {S.CHUNKS}, s AS (SELECT content IN (SELECT content FROM c WHERE content IS NOT NULL AND doc_id IN (SELECT doc_id FROM {S.STATUS} WHERE status = 'processed')) AS hit FROM c WHERE content IS NOT NULL)
      SELECT count(*) AS n, count(*) FILTER (hit) AS n_hits, round(count(*) FILTER (hit) / count(*), 6) AS ratio FROM s""",
    "keywords_ask": f"""SELECT request_id, CASE WHEN h <> '' THEN h ELSE q END AS high, CASE WHEN l <> '' THEN l ELSE q END AS low FROM (
      SELECT request_id, {_keyword_list('high_level_keywords')} AS h, {_keyword_list('low_level_keywords')} AS l, q FROM (
        SELECT r.request_id, regexp_extract(coalesce(r.text, ''), '\\{{[^{{}}]*\\}}') AS o, x.messages[-1].content AS q
        FROM (SELECT request_id, max(text) AS text FROM {_REPLIES} WHERE stage = 'keywords' GROUP BY 1) r JOIN llm_requests x USING (request_id)))""",
    "graph_truncated": _search(_TOP, 1) + ", a AS (SELECT count(*) AS n FROM adj JOIN l0 ON v = l0.name) SELECT (SELECT count(*) FROM r) AS n_nodes, (SELECT n FROM a) + 1 > (SELECT count(*) FROM r) AS truncated",
    "render_lists": f"""SELECT mention_id, CAST(to_json(source_ids) AS VARCHAR) AS ids, substr(regexp_replace(coalesce(description, ''), '[\\r\\n]+', ' ', 'g'), 1, 20) AS preview FROM {_MENTIONS} WHERE source_ids IS NOT NULL""",
    "content_of_rows": f"SELECT chunk_id, md5(coalesce(content, '')) AS content_md5 FROM {S.CHUNKS}",
    "summarize_fast": f"""WITH m AS (SELECT * FROM {_MENTIONS} WHERE coalesce(name, '') <> ''),
      n AS (SELECT name, count(*) AS n, sum(len({S.fields('description')})) AS tok FROM m WHERE description <> '' GROUP BY 1)
      SELECT h.name, coalesce(n.n, 0) AS n_descriptions, CAST(coalesce(n.tok, 0) AS INT) AS n_tokens FROM (SELECT DISTINCT name FROM m) h LEFT JOIN n USING (name)
      WHERE coalesce(n.n, 0) <= 1 OR (n.n < 6 AND n.tok < 500)""",
    "description_lines": f"""SELECT a, b, block_no, CAST(count(*) AS INT) AS n_descriptions, md5({_LINES_OF}) AS lines_md5 FROM {_PAIR_BLOCKS.format(size=50)} GROUP BY 1, 2, 3""",
    "description_line_blocks": f"""SELECT a, b, block_no, CAST(count(*) AS INT) AS n_descriptions, {_LINES_OF} AS lines FROM {_PAIR_BLOCKS.format(size=1000)} GROUP BY 1, 2, 3""",
    "graph_upsert_nodes": f"SELECT name, mention_id, type FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY coalesce(extracted_at, TIMESTAMP '1900-01-01') DESC, mention_id DESC) AS rn FROM {_MENTIONS} WHERE name <> '') WHERE rn = 1",
    "events_hourly": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "vector_manifest": "SELECT vec_id, CAST(len(embedding) AS INT) AS dim, round(list_sum(embedding[1:6]::DOUBLE[]), 6) AS head_sum FROM embeddings",
    "embed_tiled": f"SELECT chunk_id, {', '.join(_list('v', i) for i in range(8))} FROM (SELECT chunk_id, {_hash_vector('r', 8)} AS v FROM (SELECT chunk_id, {_TILED} AS r FROM {S.CHUNKS} WHERE content IS NOT NULL))",
    "embed_counter": f"""SELECT chunk_id, {', '.join(_list('v', i) for i in (0, 31, 32, 39))} FROM (SELECT chunk_id, {_hash_vector('r', 40)} AS v FROM (
      SELECT chunk_id, list_transform(range(40), lambda i: CAST('0x' || substr(h, i * 2 + 1, 2) AS BIGINT) / 127.5::DOUBLE - 1) AS r FROM (SELECT chunk_id, {_COUNTER_HEX} AS h FROM {S.CHUNKS} WHERE content IS NOT NULL)))""",
    "embed_words": f"""SELECT mention_id, {', '.join(f'coalesce(round(v[{i + 1}], 6), 0) AS v{i}' for i in range(8))} FROM (SELECT mention_id, list_transform(r, lambda x: CASE WHEN len(ds) = 0 THEN 0.0::DOUBLE ELSE x / sqrt(list_sum(list_transform(r, lambda y: y * y))) END) AS v FROM (
      SELECT mention_id, ds, [{', '.join(f"coalesce(list_sum(list_transform(ds, lambda h: CAST('0x' || substr(h, {((i * 4) % 28) * 2 + 1}, 8) AS BIGINT) / 4294967295.0::DOUBLE * 2 - 1)), 0.0::DOUBLE)" for i in range(8))}] AS r
      FROM (SELECT mention_id, list_transform({S.fields("lower(concat_ws(' ', name, description))")}, lambda w: sha256(w)) AS ds FROM {_MENTIONS})))""",
    "vec_norm": f"SELECT namespace, id, round(norm, 5) AS stored, round(CASE WHEN vector IS NULL THEN NULL ELSE sqrt(coalesce(list_sum(list_transform(vector::DOUBLE[], lambda x: x * x)), 0.0::DOUBLE)) END, 5) AS computed FROM {S.VECTORS}",
    "vec_usable": f"""SELECT namespace, CASE WHEN vector IS NULL THEN 'null' WHEN len(vector) = 0 THEN 'empty' WHEN len(vector) <> 128 THEN 'length'
      WHEN list_max(list_transform(vector, lambda x: abs(x))) = 0 THEN 'zero' ELSE 'ok' END AS state, count(*) AS n FROM {S.VECTORS} GROUP BY 1, 2""",
    "vec_cosine": "SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], o.embedding::DOUBLE[]), 6) AS score FROM embeddings e JOIN embeddings o ON o.vec_id = e.vec_id + 1",
    "vec_topk": f"SELECT vec_id, round({_COS.format(q=_FIRST)}, 6) AS score FROM embeddings ORDER BY {_COS.format(q=_FIRST)} DESC, vec_id LIMIT 10",
    "vec_topk_threshold": f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {_COS.format(q=_FIRST)} AS s FROM embeddings) WHERE s >= 0.3 ORDER BY s DESC, vec_id LIMIT 50",
    "vec_topk_batch": f"SELECT query_id, vec_id, round(s, 6) AS score, CAST(rank AS INT) AS rank FROM ({_BATCH}) WHERE rank <= 5",
    "vec_dedup_hits": f"SELECT vec_id, round(max(s), 6) AS score FROM ({_BATCH}) WHERE rank <= 50 GROUP BY 1",
    "vec_upsert": "SELECT namespace, id, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM vector_index WHERE len(vector) = 128) WHERE rn = 1",
    "vec_delete": f"SELECT namespace, id FROM {S.VECTORS} WHERE id NOT IN (SELECT unnest(chunks_list) FROM {S.STATUS} WHERE status = 'failed' AND chunks_list IS NOT NULL)",
    "graph_canonical_edges": f"SELECT least(src_id, tgt_id) AS a, greatest(src_id, tgt_id) AS b, count(*) AS n_relations FROM {_RELATIONS} WHERE {_VALID_EDGE} GROUP BY 1, 2",
    "graph_upsert_edges": f"""SELECT src_id, tgt_id, rel_id FROM (SELECT *, row_number() OVER (PARTITION BY least(src_id, tgt_id), greatest(src_id, tgt_id) ORDER BY extracted_at DESC, rel_id DESC) AS rn
      FROM {_RELATIONS} WHERE {_VALID_EDGE}) WHERE rn = 1""",
    "graph_endpoints": f"SELECT DISTINCT v AS name FROM {_ADJ} WHERE v NOT IN (SELECT name FROM entities WHERE name IS NOT NULL AND lower(type) = 'person')",
    "graph_degree": f"SELECT e.name, coalesce(d.degree, 0) AS degree FROM (SELECT DISTINCT name FROM entities WHERE name <> '') e LEFT JOIN {_DEG} d USING (name)",
    "graph_neighbors": f"SELECT v AS name, n AS neighbour FROM {_ADJ}",
    "graph_bfs_d1": _search(_TOP, 1) + _ROWS,
    "graph_bfs_d2": _search("(SELECT name FROM deg ORDER BY degree, name LIMIT 1)", 2) + _ROWS,
    "graph_induced": _search(_TOP, 1) + f" SELECT a, b FROM {_EDGES} WHERE a IN (SELECT name FROM r) AND b IN (SELECT name FROM r)",
    "graph_expand_hits": f"""WITH s AS (SELECT DISTINCT json_extract_string(metadata, '$.entity_id') AS v FROM {S.VECTORS} WHERE namespace = 'entities'), adj AS {_ADJ}, deg AS {_DEG}
      SELECT DISTINCT v AS seed, v AS name, 0 AS pos FROM adj JOIN s USING (v)
      UNION ALL SELECT seed, name, CAST(pos AS INT) FROM (SELECT adj.v AS seed, n AS name, row_number() OVER (PARTITION BY adj.v ORDER BY degree DESC, n) AS pos
        FROM adj JOIN s USING (v) JOIN deg ON deg.name = adj.n) WHERE pos <= 9""",
    "graph_top_nodes": f"SELECT name, degree FROM {_DEG} ORDER BY degree DESC, name LIMIT 20",
    "extract_entities": f"SELECT * FROM {_ENTITIES}",
    "extract_relations": f"""SELECT response_id, line_no, {_p(1)} AS src_id, {_p(2)} AS tgt_id, {_p(3)} AS keywords, {_p(4)} AS description, 1.0::DOUBLE AS weight
      FROM {_RECORDS} WHERE NOT (contains(kind, 'entity') AND len(f) >= 4) AND contains(kind, 'relation') AND len(f) >= 5 AND {_p(1)} <> '' AND {_p(2)} <> ''""",
    "extract_cache_key": f"SELECT chunk_id, 'extract:' || sha256(content || '|v1') AS cache_key FROM {S.CHUNKS}",
    "extract_cache_split": f"""WITH c AS {S.CHUNKS} SELECT chunk_id, CASE WHEN content IN (SELECT content FROM c WHERE content IS NOT NULL AND doc_id IN (SELECT doc_id FROM {S.STATUS} WHERE status = 'processed'))
      THEN 'hit' ELSE 'miss' END AS state FROM c WHERE content IS NOT NULL""",
    "extract_glean": f"""WITH e AS (SELECT x.*, r.source, r.stage FROM {_ENTITIES} x JOIN {_REPLIES} r USING (response_id)),
      f AS (SELECT source, name FROM e WHERE stage = 'extract' GROUP BY ALL),
      g AS (SELECT DISTINCT source, name FROM e WHERE stage = 'glean' AND source IN (SELECT source FROM f) AND (source, name) NOT IN (SELECT (source, name) FROM f))
      SELECT source, 0 AS round, count(*) AS n_names FROM f GROUP BY 1 UNION ALL SELECT source, 1, count(*) FROM g GROUP BY 1""",
    "summarize_windows": f"""WITH RECURSIVE m AS (SELECT k, t, len({S.fields('t')}) AS tok, rn FROM {_NAMED}), {_packed("w", "m", 200)}
      SELECT k AS name, CAST(block_no AS INT) AS block_no, window_no, CAST(count(*) AS INT) AS n_texts, CAST(sum(tok) AS INT) AS n_tokens FROM w GROUP BY 1, 2, 3""",
    "summarize_full": f"WITH RECURSIVE {_summaries(_NAMED)} SELECT k AS name, description, llm_used FROM summed",
    "merge_entity_sources": f"""SELECT name, segment_no, CAST(count(*) AS INT) AS n_elements, md5(string_agg(e, '|' ORDER BY e)) AS elements_md5
      FROM (SELECT *, (row_number() OVER (PARTITION BY name ORDER BY e) - 1) // 100 AS segment_no FROM (SELECT DISTINCT name, e FROM (SELECT name, unnest(source_ids) AS e FROM {_MENTIONS}) WHERE name <> '' AND e <> '')) GROUP BY 1, 2""",
    "merge_relation_sources": f"""SELECT a AS src_id, b AS tgt_id, segment_no, CAST(count(*) AS INT) AS n_elements, md5(string_agg(e, '|' ORDER BY e)) AS elements_md5
      FROM (SELECT *, (row_number() OVER (PARTITION BY a, b ORDER BY e) - 1) // 100 AS segment_no FROM (SELECT DISTINCT a, b, e FROM (
        SELECT least(src_id, tgt_id) AS a, greatest(src_id, tgt_id) AS b, unnest(source_ids) AS e FROM {_RELATIONS} WHERE {_VALID_EDGE}) WHERE e <> '')) GROUP BY 1, 2, 3""",
    "merge_entities": f"""WITH RECURSIVE m AS (SELECT * FROM {_MENTIONS} WHERE coalesce(name, '') <> ''),
      h AS (SELECT name, count(*) AS n_mentions FROM m GROUP BY 1), t AS (SELECT name, type FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY extracted_at NULLS FIRST, mention_id) AS rn FROM m) WHERE rn = 1),
      s AS (SELECT name, count(DISTINCT x) AS n_sources FROM (SELECT name, unnest(source_ids) AS x FROM m) WHERE x <> '' GROUP BY 1),
      n AS (SELECT name, count(*) AS n FROM m WHERE description <> '' GROUP BY 1), {_summaries(_NAMED)}
      SELECT h.name, t.type, h.n_mentions, coalesce(n.n, 0) AS n_descriptions, coalesce(s.n_sources, 0) AS n_sources, md5(coalesce(d.description, '')) AS description
      FROM h JOIN t USING (name) LEFT JOIN s USING (name) LEFT JOIN n USING (name) LEFT JOIN summed d ON d.k = h.name""",
    "merge_relations": f"""WITH RECURSIVE m AS (SELECT *, least(src_id, tgt_id) AS a, greatest(src_id, tgt_id) AS b, least(src_id, tgt_id) || chr(1) || greatest(src_id, tgt_id) AS k FROM {_RELATIONS} WHERE {_VALID_EDGE}),
      h AS (SELECT a, b, k, coalesce(sum(CAST(round(weight * 1000) AS BIGINT)) / 1000.0::DOUBLE, 0) AS weight, count(*) AS n_relations FROM m GROUP BY 1, 2, 3),
      q AS (SELECT k, string_agg(keywords, ',' ORDER BY e, r) AS keywords FROM (SELECT k, keywords, min(coalesce(extracted_at, TIMESTAMP '1900-01-01')) AS e, arg_min(rel_id, (coalesce(extracted_at, TIMESTAMP '1900-01-01'), rel_id)) AS r FROM m WHERE keywords <> '' GROUP BY 1, 2) GROUP BY 1),
      s AS (SELECT k, count(DISTINCT x) AS n_sources FROM (SELECT k, unnest(source_ids) AS x FROM m) WHERE x <> '' GROUP BY 1),
      o AS (SELECT k, description AS t, row_number() OVER (PARTITION BY k ORDER BY extracted_at NULLS FIRST, rel_id) - 1 AS rn FROM m WHERE description <> ''), {_summaries("o")}
      SELECT h.a AS src_id, h.b AS tgt_id, round(h.weight, 2) AS weight, coalesce(q.keywords, '') AS keywords, h.n_relations, coalesce(s.n_sources, 0) AS n_sources, md5(coalesce(d.description, '')) AS description
      FROM h LEFT JOIN q USING (k) LEFT JOIN s USING (k) LEFT JOIN summed d USING (k)""",
    "keywords_parse": f"""SELECT response_id, {_keyword_list('high_level_keywords')} AS high, {_keyword_list('low_level_keywords')} AS low
      FROM (SELECT response_id, {_FIRST_OBJECT} AS o FROM {_REPLIES} WHERE stage = 'keywords' AND text IS NOT NULL)""",
    "keywords_fallback": f"""SELECT response_id, CASE WHEN l <> '' THEN l ELSE q END AS low FROM (SELECT response_id, {_keyword_list('low_level_keywords')} AS l, q
      FROM (SELECT r.response_id, regexp_extract(coalesce(r.text, ''), '\\{{[^{{}}]*\\}}') AS o, x.messages[-1].content AS q FROM {_REPLIES} r JOIN llm_requests x USING (request_id) WHERE r.stage = 'keywords'))""",
    "render_entities": f"SELECT mention_id, '- ' || name || ' (' || coalesce(nullif(type, ''), 'entity') || '): ' || coalesce(description, '') AS line FROM {_MENTIONS} WHERE name IS NOT NULL",
    "render_relations": f"""SELECT rel_id, '- ' || src_id || ' -> ' || tgt_id || ' [' || coalesce(nullif(keywords, ''), '(none)') || ']: ' || coalesce(description, '') AS line
      FROM {_RELATIONS} WHERE src_id IS NOT NULL AND tgt_id IS NOT NULL""",
    "pack_chunks": f"""SELECT doc_id, chunk_id, n_tokens FROM (SELECT *, sum(n_tokens) OVER w AS cum, row_number() OVER w AS rn FROM (
      SELECT chunk_id, doc_id, CAST(coalesce(len({S.fields('content')}), 0) AS INT) AS n_tokens, coalesce(chunk_order_index, -1) AS i FROM {S.CHUNKS})
      WINDOW w AS (PARTITION BY doc_id ORDER BY i, chunk_id ROWS UNBOUNDED PRECEDING)) WHERE rn = 1 OR (cum <= 300 AND cum - n_tokens < 300)""",
    "hybrid_chunk_union": """SELECT name, count(*) FILTER (side = 0) AS n_local, count(*) FILTER (side = 1) AS n_added FROM (SELECT name, c, min(side) AS side FROM (
      SELECT name, unnest(source_ids) AS c, 0 AS side FROM entities UNION ALL SELECT src_id, unnest(source_ids), 1 FROM relations) WHERE name <> '' AND c <> '' GROUP BY 1, 2) GROUP BY 1""",
    "entity_union": """WITH g AS (SELECT DISTINCT n FROM (SELECT src_id AS n FROM relations UNION ALL SELECT tgt_id FROM relations) WHERE n <> '')
      SELECT 'global' AS side, count(*) AS n FROM g UNION ALL SELECT 'local', count(DISTINCT name) FROM entities WHERE name <> '' AND name NOT IN (SELECT n FROM g)""",
    "llm_usage": f"""SELECT q.model, count(DISTINCT q.request_id) AS n_requests, count(r.response_id) AS n_responses, sum(r.input_tokens) AS input_tokens, sum(r.output_tokens) AS output_tokens
      FROM llm_requests q LEFT JOIN {_REPLIES} r USING (request_id) GROUP BY 1""",
}
