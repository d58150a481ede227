"""Queries of the four retrieval modes and the deterministic providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import embed, providers
from quern.operators import graph, retrieval, store
from quern.operators.prompting import QueryParam
from quern.plans import sqltext as S
from quern.plans.documents import chunks_now
from quern.plans.knowledge import _MENTIONS, _RELATIONS, _VALID_EDGE
from quern.sources.tables import materialise, table

QUESTION = "Which trade guild fortified the monastery near the harbour?"
HIGH, LOW = ["trade guild", "monastery"], ["harbour", "guild"]
DIM, CHUNKS = 128, 20


def embed_question(text: str) -> list[float]:
    return embed.counter_vector(text, DIM)


def _meta(name: str):
    return F.get_json_object("metadata", f"$.{name}")


def _first_sources(pairs: DataFrame, keys: list[str], chunks: int) -> DataFrame:
    """The first sources of each key, as many as an answer of ``chunks`` chunks can use.

    Of any one list it can use at most so many, besides as many seen before, so
    lists of twice that length give the same answer and stay bounded for a key of a
    third of all rows.
    """
    rank = Window.partitionBy(*keys).orderBy("s")
    first = pairs.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= 2 * chunks)
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("source_ids"))


def stores(spark: SparkSession, d: str, mode: str, chunks: int = CHUNKS) -> retrieval.Stores:
    """The tables a mode needs for answers of ``chunks`` chunks: vectors of full length, merged entities and edges."""
    def index(namespace: str) -> DataFrame:
        # An id is in one namespace, so only its rows are read before the latest are taken.
        rows = table(spark, d, "vector_index").filter(F.col("namespace") == namespace).select("id", "vector", "metadata", "ingested_at")
        return store.latest(rows, "id", "ingested_at").filter(F.size("vector") == DIM)

    out = retrieval.Stores(chunks_now(spark, d))
    if mode == "naive":
        out.chunk_index = index("chunks").select("id", "vector")
        return out
    mentions = store.latest(table(spark, d, "entities"), "mention_id", "extracted_at").filter("name <> ''")
    heads = mentions.groupBy("name").agg(F.min_by(F.struct("type", "description"), F.struct("extracted_at", "mention_id")).alias("h")).select("name", "h.*")
    sources = (mentions.select("name", F.explode("source_ids").alias("s")).filter("s <> ''").distinct())
    out.entities = heads.join(_first_sources(sources, ["name"], chunks), "name", "left").withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<string>")))
    relations = store.latest(table(spark, d, "relations"), "rel_id", "extracted_at")
    edges = graph.keyed(relations)
    top = edges.groupBy("a", "b").agg(F.min_by(F.struct("keywords", "description"), F.struct("extracted_at", "rel_id")).alias("h")).select("a", "b", "h.*")
    cited = edges.select("a", "b", F.explode("source_ids").alias("s")).filter("s <> ''").distinct()
    out.relations = materialise(top.join(_first_sources(cited, ["a", "b"], chunks), ["a", "b"], "left").withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<string>"))), "answer-edges")
    if mode in ("local", "hybrid"):
        out.entity_index = index("entities").select("id", "vector", _meta("entity_id").alias("entity_id"))
    if mode in ("global", "hybrid"):
        rows = relations.select(F.col("rel_id").alias("_id"), "src_id", "tgt_id", "keywords", "description", F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"))
        out.relation_index = (index("relations").select("id", "vector", _meta("rel_id").alias("_id")).join(rows, "_id").drop("_id"))
    return out


def _refs(spark: SparkSession, d: str, mode: str) -> DataFrame:
    param = QueryParam(mode=mode, top_k=10, chunk_top_k=CHUNKS)
    s = stores(spark, d, mode, param.with_defaults().chunk_top_k)
    rows = retrieval.context_rows(s, retrieval.references(s, QUESTION, embed_question, param, HIGH, LOW))
    return rows.select("ord", "chunk_id", F.octet_length("content").alias("n_bytes"))


def retrieve_naive(spark: SparkSession, d: str) -> DataFrame:
    """References of the vector-only mode."""
    return _refs(spark, d, "naive")


def retrieve_local(spark: SparkSession, d: str) -> DataFrame:
    """References of the entity-centric mode."""
    return _refs(spark, d, "local")


def retrieve_global(spark: SparkSession, d: str) -> DataFrame:
    """References of the relation-centric mode."""
    return _refs(spark, d, "global")


def retrieve_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """References of both, local ones first."""
    return _refs(spark, d, "hybrid")


def prompt_assemble(spark: SparkSession, d: str) -> DataFrame:
    """The answer of the hybrid mode by the context-echo stand-in: a row."""
    param = QueryParam(chunk_top_k=CHUNKS, max_total_tokens=2000)
    s = stores(spark, d, "hybrid", param.with_defaults().chunk_top_k)

    def echo(prompt: str) -> str:
        return spark.range(1).select(providers.context_echo(F.lit(prompt.replace("Passages:", "Context:", 1)))).first()[0]

    out = retrieval.answer(s, QUESTION, embed_question, param, echo, HIGH, LOW)
    return spark.createDataFrame([(out["content"], out["references"], out["packed"], out["mode"])], "content string, references array<string>, packed array<string>, mode string")


def llm_echo(spark: SparkSession, d: str) -> DataFrame:
    """Echo of every request, with token estimates."""
    q = table(spark, d, "llm_requests")
    return q.select("request_id", providers.echo(F.col("system")).alias("text"), providers.byte_tokens(F.col("system")).alias("n_tokens"))


def llm_hash(spark: SparkSession, d: str) -> DataFrame:
    """A reply that depends on the model, the system text and the last message."""
    q = table(spark, d, "llm_requests")
    request = F.struct("model", F.coalesce("system", F.lit("")).alias("system"), F.element_at("messages", -1)["content"].alias("content"))
    return q.select("request_id", providers.hashed(request).alias("text"))


QUERIES = {f.__name__: f for f in (retrieve_naive, retrieve_local, retrieve_global, retrieve_hybrid, prompt_assemble, llm_echo, llm_hash)}


def _vector(text: str) -> str:
    return "[" + ", ".join(repr(x) for x in embed_question(text)) + "]::DOUBLE[]"


def _score(q: str) -> str:
    # The length of the query is not exactly 1 in floating point, so it is part of the formula.
    return f"CASE WHEN list_sum(list_transform(vector, lambda x: abs(x))) = 0 THEN 0 ELSE list_cosine_similarity(vector::DOUBLE[], {q}) END"


_FULL = f"(SELECT * FROM {S.VECTORS} WHERE len(vector) = {DIM})"


def _hits(namespace: str, words: list[str]) -> str:
    one = " UNION ALL ".join(f"(SELECT id, {_score(_vector(w))} AS s FROM {_FULL} WHERE namespace = '{namespace}' ORDER BY s DESC, id LIMIT 10)" for w in words)
    return f"(SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM (SELECT id, max(s) AS s FROM ({one}) GROUP BY 1))"


_COMMON = f"""
  m AS (SELECT * FROM {_MENTIONS} WHERE name <> ''), rel AS (SELECT *, least(src_id, tgt_id) AS a, greatest(src_id, tgt_id) AS b FROM {_RELATIONS}),
  ent AS (SELECT name, list_sort(list(DISTINCT s) FILTER (s <> '')) AS src FROM (SELECT name, unnest(CASE WHEN len(source_ids) > 0 THEN source_ids ELSE [''] END) AS s FROM m) GROUP BY 1),
  edg AS (SELECT a, b, list_sort(list(DISTINCT s) FILTER (s <> '')) AS src FROM (SELECT a, b, unnest(CASE WHEN len(source_ids) > 0 THEN source_ids ELSE [''] END) AS s FROM rel WHERE {_VALID_EDGE}) GROUP BY 1, 2),
  adj AS (SELECT a AS v, b AS n FROM edg UNION ALL SELECT b, a FROM edg), deg AS (SELECT v AS name, count(*) AS degree FROM adj GROUP BY 1)"""
_LOCAL = f"""
  lh AS (SELECT coalesce(nullif(json_extract_string(x.metadata, '$.entity_id'), ''), h.id) AS name, min(h.r) AS r FROM {_hits('entities', LOW)} h JOIN {_FULL} x USING (id) GROUP BY 1),
  near AS (SELECT lh.name AS seed, lh.name AS name, 0 AS pos, lh.r FROM lh WHERE name IN (SELECT name FROM deg)
    UNION ALL SELECT seed, name, pos, r FROM (SELECT lh.name AS seed, adj.n AS name, row_number() OVER (PARTITION BY lh.name ORDER BY degree DESC, adj.n) AS pos, lh.r
      FROM lh JOIN adj ON adj.v = lh.name JOIN deg ON deg.name = adj.n) WHERE pos <= 9),
  ln AS (SELECT name, min((r, pos)) AS o FROM near GROUP BY 1),
  le AS (SELECT e.a, e.b, min(p.r) AS r FROM edg e JOIN near p ON p.name = e.a JOIN near q ON q.name = e.b AND q.seed = p.seed GROUP BY 1, 2),
  lp AS (SELECT 0 AS s, o[1] AS x, o[2] AS y, name AS z, '' AS w, src FROM ln JOIN ent USING (name) UNION ALL SELECT 1, le.r, 0, a, b, src FROM le JOIN edg USING (a, b))"""
_GLOBAL = f"""
  gr AS (SELECT h.r, rel.src_id, rel.tgt_id, rel.a, rel.b, rel.source_ids FROM {_hits('relations', HIGH)} h JOIN {_FULL} x USING (id) JOIN rel ON rel.rel_id = json_extract_string(x.metadata, '$.rel_id') WHERE {_VALID_EDGE}),
  ge AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY r DESC) AS rn FROM gr) WHERE rn = 1),
  gn AS (SELECT name, min((r, side)) AS o FROM (SELECT r, 0 AS side, src_id AS name FROM ge UNION ALL SELECT r, 1, tgt_id FROM ge) WHERE name IN (SELECT name FROM ent) GROUP BY 1),
  gp AS (SELECT 2 AS s, r AS x, 0 AS y, a AS z, b AS w, source_ids AS src FROM ge UNION ALL SELECT 3, o[1], o[2], name, '', src FROM gn JOIN ent USING (name))"""


def _context(parts: str, source: str) -> str:
    return f"""WITH {_COMMON}, {parts},
  u AS (SELECT s, x, y, z, w, unnest(src) AS chunk_id, generate_subscripts(src, 1) AS p FROM ({source})),
  f AS (SELECT chunk_id, min((s, x, y, z, w, p)) AS o FROM u WHERE chunk_id <> '' GROUP BY 1),
  t AS (SELECT chunk_id, row_number() OVER (ORDER BY o) AS ord FROM f)
  SELECT CAST(ord AS INT) AS ord, chunk_id, CAST(strlen(content) AS INT) AS n_bytes FROM t JOIN {S.CHUNKS} c USING (chunk_id) WHERE ord <= 20 AND len({S.fields('content')}) > 0"""


SQL = {
    "retrieve_naive": f"""SELECT CAST(ord AS INT) AS ord, chunk_id, CAST(strlen(content) AS INT) AS n_bytes FROM (SELECT id AS chunk_id, row_number() OVER (ORDER BY s DESC, id) AS ord
      FROM (SELECT id, {_score(_vector(QUESTION))} AS s FROM {_FULL} WHERE namespace = 'chunks')) JOIN {S.CHUNKS} c USING (chunk_id) WHERE ord <= 20 AND len({S.fields('content')}) > 0""",
    "retrieve_local": _context(_LOCAL, "SELECT * FROM lp"),
    "retrieve_global": _context(_GLOBAL, "SELECT * FROM gp"),
    "retrieve_hybrid": _context(_LOCAL + "," + _GLOBAL, "SELECT * FROM lp UNION ALL SELECT * FROM gp"),
    "llm_echo": "SELECT request_id, coalesce(system, '') AS text, CAST(strlen(coalesce(system, '')) // 4 AS INT) AS n_tokens FROM llm_requests",
    "llm_hash": """SELECT request_id, 'mock-' || substr(sha256(CAST(to_json(struct_pack(model := model, system := coalesce(system, ''), content := messages[-1].content)) AS VARCHAR)), 1, 16) AS text FROM llm_requests""",
}
