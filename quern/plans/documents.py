"""Queries over documents, chunks, stores and document status."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import bpe
from quern.functions import text as T
from quern.operators import chunking, docstatus, graph, store
from quern.plans import sqltext as S
from quern.sources import snapshots
from quern.sources.tables import shared_dir, table

#: Place of a public vocabulary.
RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def chunks_now(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(table(spark, d, "chunks"), "chunk_id", "created_at")


def doc_id_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Enqueue of all documents into an empty status table: one row per distinct content."""
    empty = spark.createDataFrame([], "doc_id string")
    out = docstatus.enqueue(empty, table(spark, d, "documents"), "text", "file_path", "doc_id", F.lit("2026-05-09 12:00:00").cast("timestamp_ntz"))
    return out.select(F.col("doc_id").alias("content_id"), "content_summary", "content_length", "file_path", "status")


def doc_enqueue_fresh(spark: SparkSession, d: str) -> DataFrame:
    """Enqueue of all documents when the contents of all chunks are known already."""
    known = table(spark, d, "chunks").filter("content is not null").select(T.content_id(F.col("content")).alias("doc_id")).distinct()
    out = docstatus.enqueue(known, table(spark, d, "documents"), "text", "file_path", "doc_id", F.lit("2026-05-09 12:00:00").cast("timestamp_ntz"))
    return out.select(F.col("doc_id").alias("content_id"), "content_length")


def doc_status_matrix(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of states with whether the change is allowed."""
    states = spark.createDataFrame([(a, b) for a in docstatus.STATES for b in docstatus.STATES], "from_status string, to_status string")
    return states.withColumn("is_valid", docstatus.is_valid(F.col("from_status"), F.col("to_status")))


def doc_status_list(spark: SparkSession, d: str) -> DataFrame:
    """Documents a resumed run takes up, by their latest delivery."""
    return docstatus.by_status(docstatus.current(table(spark, d, "doc_status"))).select("doc_id", "status")


def doc_status_apply(spark: SparkSession, d: str) -> DataFrame:
    """Marks every document processed for which all listed chunks have content, failed otherwise; forbidden changes are ignored."""
    now = docstatus.current(table(spark, d, "doc_status"))
    lists = now.select("doc_id", F.coalesce("chunks_list", F.array().cast("array<string>")).alias("chunks_list"))
    found = store.fetch_ordered(lists, "doc_id", "chunks_list", chunks_now(spark, d), "chunk_id", "content").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    complete = (F.size("chunks_list") > 0) & (F.coalesce("n", F.lit(0)) == F.size("chunks_list"))
    changes = lists.join(found, "doc_id", "left").select("doc_id", F.when(complete, "processed").otherwise("failed").alias("to_status"), "chunks_list")
    out = docstatus.transition(now, changes, F.lit("2026-05-09 12:00:00").cast("timestamp_ntz"), strict=False)
    return out.select("doc_id", "status", F.size("chunks_list").alias("n_chunks"), "updated_at")


def doc_status_fold(spark: SparkSession, d: str) -> DataFrame:
    """State of a per-user machine after all events in order."""
    target = (F.when(F.col("event_type").isin("signup", "view"), "processing").when(F.col("event_type") == "click", "processed").otherwise("failed"))
    out = docstatus.fold(table(spark, d, "events"), "user_id", target, ["ts", "event_id"], F.date_trunc("day", "ts"))
    return out.select("user_id", "status", "applied")


def _chunked(spark: SparkSession, d: str, size: int, overlap: int) -> DataFrame:
    out = chunking.by_tokens(table(spark, d, "documents"), "doc_id", "text", size, overlap)
    return out.select(F.col("id").alias("doc_id"), "chunk_order_index", F.md5("content").alias("content_md5"), "tokens")


def chunk_tokens_1200_100(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 1200 tokens, 100 shared."""
    return _chunked(spark, d, 1200, 100)


def chunk_tokens_50_10(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 50 tokens, 10 shared."""
    return _chunked(spark, d, 50, 10)


def chunk_runes(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 1200 characters, 200 shared, with tokens counted again."""
    out = chunking.by_characters(table(spark, d, "documents"), "doc_id", "text", 300, 50)
    return out.select(F.col("id").alias("doc_id"), "chunk_order_index", F.md5("content").alias("content_md5"), "tokens")


def chunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs cut every 1200 characters."""
    out = chunking.by_paragraphs(table(spark, d, "documents"), "doc_id", "text", 1200)
    return out.select(F.col("id").alias("doc_id"), "chunk_order_index", F.md5("content").alias("content_md5"), "tokens")


def chunk_paragraphs_whole(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of any length with their words counted."""
    out = chunking.by_paragraphs(table(spark, d, "documents"), "doc_id", "text", None)
    return out.select(F.col("id").alias("doc_id"), "chunk_order_index", F.md5("content").alias("content_md5"), "tokens")


def token_count(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every chunk as stored and as counted."""
    return chunks_now(spark, d).select("chunk_id", F.col("tokens").alias("stored_tokens"), T.token_count(F.col("content")).alias("n_tokens"))


def truncate_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Every document cut to 100 tokens."""
    return table(spark, d, "documents").select("doc_id", F.md5(T.truncate_tokens(F.col("text"), 100)).alias("text_md5"), T.token_count(T.truncate_tokens(F.col("text"), 100)).alias("n_tokens"))


def blank_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a token, by type."""
    return table(spark, d, "documents").filter(T.is_blank(F.col("text"))).groupBy("doc_type").agg(F.count(F.lit(1)).alias("n_blank"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select(F.explode("source_ids").alias("chunk_id"))


def kv_get_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that mentions point to."""
    return store.get_by_ids(chunks_now(spark, d), _sources(spark, d), "chunk_id").select("chunk_id", F.md5("content").alias("content_md5"))


def kv_filter_missing(spark: SparkSession, d: str) -> DataFrame:
    """Ids that mentions point to and the chunk table lacks, once each."""
    return store.filter_missing(_sources(spark, d), table(spark, d, "chunks"), "chunk_id")


def kv_missing_repeated(spark: SparkSession, d: str) -> DataFrame:
    """The same with repeats kept, counted."""
    return store.filter_missing(_sources(spark, d), table(spark, d, "chunks"), "chunk_id", distinct=False).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))


def kv_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Pinned chunks and all deliveries of chunks written in turn: the last writer wins."""
    out = store.upsert(table(spark, d, "pinned_chunks"), table(spark, d, "chunks"), "chunk_id", "created_at")
    return out.select("chunk_id", "doc_id", "created_at", F.md5("content").alias("content_md5"))


def kv_delete(spark: SparkSession, d: str) -> DataFrame:
    """Chunks left when those of failed documents are deleted."""
    failed = docstatus.by_status(docstatus.current(table(spark, d, "doc_status")), "failed").select("doc_id")
    return store.delete(chunks_now(spark, d), failed, "doc_id").select("chunk_id", "doc_id")


def kv_count(spark: SparkSession, d: str) -> DataFrame:
    """Entries of each namespace."""
    return table(spark, d, "vector_index").select("namespace", "id").distinct().groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return docstatus.current(table(spark, d, "doc_status")).select("doc_id", "chunks_list")


def fetch_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Listed chunks of every document in list order; missing and blank ones dropped."""
    out = store.fetch_ordered(_lists(spark, d), "doc_id", "chunks_list", chunks_now(spark, d), "chunk_id", "content")
    return out.filter(~T.is_blank(F.col("content"))).select("doc_id", "pos", F.col("id").alias("chunk_id"), F.octet_length("content").alias("n_bytes"))


def fetch_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Listed chunks in list order; missing ones with an empty content."""
    out = store.fetch_ordered(_lists(spark, d), "doc_id", "chunks_list", chunks_now(spark, d), "chunk_id", "content", keep_missing=True)
    return out.select("doc_id", "pos", F.col("id").alias("chunk_id"), F.octet_length("content").alias("n_bytes"))


def chunk_bpe(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk in windows of 64 byte-pair tokens that share 16, put together again: windows, tokens and a checksum of the text."""
    encode, decode = bpe.encoder(RANK_FILE), bpe.decoder(RANK_FILE)
    rows = chunks_now(spark, d).filter("content is not null and content <> ''").select("chunk_id", "content")
    windows = chunking.by_tokens(rows, "chunk_id", "content", 64, 16, encode, lambda part: part)
    # All windows but the first repeat their first 16 tokens; a chunk has few of them.
    own = F.when(F.col("chunk_order_index") == 0, F.col("content")).otherwise(F.expr("slice(content, 17, 64)"))
    parts = windows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("chunk_order_index", own.alias("t")))).alias("p"), F.max("tokens").alias("most_tokens"))
    return parts.select(F.col("id").alias("chunk_id"), (F.col("most_tokens") <= 64).alias("within"), F.md5(decode(F.flatten(F.transform("p", lambda x: x["t"])))).alias("content_md5"))


def json_records(spark: SparkSession, d: str) -> DataFrame:
    """Nations written as a JSON record file and read back."""
    path = f"{shared_dir(spark)}/nations-{uuid.uuid4().hex}.json"
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"), F.array("n_name").alias("names"))
    snapshots.export_records(rows, path, "id")
    back = snapshots.load_records(spark, path, "id", rows.schema)
    return back.select("id", "name", "region", F.size("names").alias("n_names"))


def json_graph(spark: SparkSession, d: str) -> DataFrame:
    """Nations and their regions written as a JSON graph file and read back: the edges, and the nodes at both ends."""
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}.json"
    none = F.array().cast("array<string>").alias("source_ids")
    regions = table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k"))
    nations = table(spark, d, "nation").join(F.broadcast(regions), F.col("n_regionkey") == F.col("k"))  # five regions
    nodes = nations.select(F.col("n_name").alias("name"), F.lit("nation").alias("type"), F.lit("").alias("description"), none)
    edges = graph.keyed(nations.select(F.col("n_name").alias("src_id"), F.col("name").alias("tgt_id"), F.lit("in").alias("keywords"), F.lit("").alias("description"), F.lit(1.0).alias("weight"), none))
    snapshots.export_graph(nodes, edges, path)
    back, lines = snapshots.load_graph(spark, path)
    return lines.join(back.select(F.col("name").alias("a")), "a", "left_semi").join(back.select(F.col("name").alias("b")), "b", "left_semi").select("a", "b", "weight")


def json_vectors(spark: SparkSession, d: str) -> DataFrame:
    """One vector a nation written as a JSON vector file and read back."""
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}.json"
    rows = table(spark, d, "nation").select(F.col("n_name").alias("id"), F.array(F.col("n_nationkey").cast("float"), F.lit(1).cast("float")).alias("vector"), F.create_map(F.lit("k"), F.col("n_name")).alias("metadata"))
    snapshots.export_vectors(rows, path, "nations", 2)
    return snapshots.load_vectors(spark, path).select("namespace", "dim", "id", F.get("vector", F.lit(0)).cast("double").alias("first"), F.col("metadata")["k"].alias("k"))


QUERIES = {f.__name__: f for f in (chunk_bpe, json_records, json_graph, json_vectors, 
    doc_id_dedup, doc_enqueue_fresh, doc_status_matrix, doc_status_list, doc_status_apply, doc_status_fold, chunk_tokens_1200_100, chunk_tokens_50_10, chunk_runes,
    chunk_paragraphs, chunk_paragraphs_whole, token_count, truncate_tokens, blank_texts, kv_get_by_ids, kv_filter_missing, kv_missing_repeated, kv_upsert, kv_delete,
    kv_count, fetch_ordered, fetch_with_gaps)}

_ENQUEUED = """SELECT md5(text) AS content_id, substr(arg_min(text, doc_id), 1, 100) AS content_summary, strlen(arg_min(text, doc_id)) AS content_length,
        arg_min(struct_pack(p := file_path), doc_id).p AS file_path, 'pending' AS status FROM documents WHERE text IS NOT NULL GROUP BY 1"""
_VALID = " OR ".join(f"(a = '{a}' AND b = '{b}')" for a, b in docstatus.TRANSITIONS)
_WORDS = f"(SELECT doc_id, {S.fields('text')} AS w FROM documents WHERE text IS NOT NULL)"


def _token_windows(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""SELECT doc_id, CAST(i AS INT) AS chunk_order_index, md5(array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ')) AS content_md5,
        CAST(len(w[i * {step} + 1 : i * {step} + {size}]) AS INT) AS tokens
      FROM (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - {size}) / {float(step)})) AS INT) + 1)) AS i FROM {_WORDS} WHERE len(w) > 0)"""


_DENSE = "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {order}) - 1 AS INT) AS chunk_order_index"

SQL = {
    "chunk_bpe": f"SELECT chunk_id, true AS within, md5(content) AS content_md5 FROM {S.CHUNKS} WHERE content IS NOT NULL AND content <> ''",
    "json_records": "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region, CAST(1 AS INT) AS n_names FROM nation",
    "json_graph": "SELECT least(n_name, r_name) AS a, greatest(n_name, r_name) AS b, 1.0::DOUBLE AS weight FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_name <> r_name",
    "json_vectors": "SELECT 'nations' AS namespace, CAST(2 AS INT) AS dim, n_name AS id, CAST(n_nationkey AS DOUBLE) AS first, n_name AS k FROM nation",
    "doc_id_dedup": _ENQUEUED,
    "doc_enqueue_fresh": f"SELECT content_id, content_length FROM ({_ENQUEUED}) WHERE content_id NOT IN (SELECT md5(content) FROM chunks WHERE content IS NOT NULL)",
    "doc_status_matrix": f"""SELECT a AS from_status, b AS to_status, ({_VALID}) AS is_valid
      FROM (VALUES ('pending'), ('processing'), ('processed'), ('failed')) x(a), (VALUES ('pending'), ('processing'), ('processed'), ('failed')) y(b)""",
    "doc_status_list": f"SELECT doc_id, status FROM {S.STATUS} WHERE status IN ('pending', 'processing', 'failed')",
    "doc_status_apply": f"""
      WITH s AS {S.STATUS}, l AS (SELECT doc_id, unnest(chunks_list) AS chunk_id FROM s),
      n AS (SELECT l.doc_id, count(*) AS n FROM l JOIN {S.CHUNKS} c USING (chunk_id) WHERE trim(c.content, ' ') <> '' GROUP BY 1),
      t AS (SELECT s.*, CASE WHEN len(coalesce(chunks_list, [])) > 0 AND coalesce(n.n, 0) = len(chunks_list) THEN 'processed' ELSE 'failed' END AS b, status AS a FROM s LEFT JOIN n USING (doc_id)),
      o AS (SELECT *, ({_VALID}) AS ok FROM t)
      SELECT doc_id, CASE WHEN ok THEN b ELSE a END AS status,
        CAST(CASE WHEN ok THEN len(coalesce(chunks_list, [])) WHEN chunks_list IS NULL THEN NULL ELSE len(chunks_list) END AS INT) AS n_chunks,
        CASE WHEN ok THEN TIMESTAMP '2026-05-09 12:00:00' ELSE updated_at END AS updated_at FROM o""",
    "doc_status_fold": """
      WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
          CASE WHEN event_type IN ('signup', 'view') THEN 'processing' WHEN event_type = 'click' THEN 'processed' ELSE 'failed' END AS b FROM events),
      r AS (SELECT user_id, CAST(0 AS BIGINT) AS i, 'pending' AS a, CAST(0 AS BIGINT) AS applied FROM (SELECT DISTINCT user_id FROM events)
        UNION ALL SELECT r.user_id, e.i, CASE WHEN %s THEN e.b ELSE r.a END, r.applied + CASE WHEN %s THEN 1 ELSE 0 END
        FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
      SELECT user_id, arg_max(a, i) AS status, arg_max(applied, i) AS applied FROM r GROUP BY 1""" % ((_VALID.replace("(a =", "(r.a =").replace("AND b =", "AND e.b ="),) * 2),
    "chunk_tokens_1200_100": _token_windows(1200, 100),
    "chunk_tokens_50_10": _token_windows(50, 10),
    "chunk_runes": f"""
      SELECT doc_id, {_DENSE.format(order='i')}, md5(p) AS content_md5, CAST(len({S.fields('p')}) AS INT) AS tokens
      FROM (SELECT doc_id, i, {S.trimmed('substr(text, CAST(i * 1000 + 1 AS INT), 1200)')} AS p
        FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 1200) / 1000.0)) AS INT) + 1)) AS i FROM documents WHERE len({S.fields('text')}) > 0)) WHERE p <> ''""",
    "chunk_paragraphs": f"""
      WITH p AS (SELECT doc_id, j, {S.trimmed('q')} AS q FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS q, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS j FROM documents)),
      c AS (SELECT doc_id, j, i, substr(q, CAST(i * 1200 + 1 AS INT), 1200) AS t FROM (SELECT *, unnest(range(0, (length(q) - 1) // 1200 + 1)) AS i FROM p WHERE q <> ''))
      SELECT doc_id, {_DENSE.format(order='j, i')}, md5(t) AS content_md5, CAST(length(t) AS INT) AS tokens FROM c""",
    "chunk_paragraphs_whole": f"""
      WITH p AS (SELECT doc_id, j, {S.trimmed('q')} AS q FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS q, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS j FROM documents))
      SELECT doc_id, {_DENSE.format(order='j')}, md5(q) AS content_md5, CAST(len({S.fields('q')}) AS INT) AS tokens FROM p WHERE q <> ''""",
    "token_count": f"SELECT chunk_id, tokens AS stored_tokens, CAST(coalesce(len({S.fields('content')}), 0) AS INT) AS n_tokens FROM {S.CHUNKS}",
    "truncate_tokens": f"""SELECT doc_id, md5(CASE WHEN len(w) <= 100 THEN text ELSE array_to_string(w[1:100], ' ') END) AS text_md5, CAST(coalesce(least(len(w), 100), 0) AS INT) AS n_tokens
      FROM (SELECT doc_id, text, {S.fields('text')} AS w FROM documents)""",
    "blank_texts": f"SELECT doc_type, count(*) AS n_blank FROM documents WHERE coalesce(len({S.fields('text')}), 0) = 0 GROUP BY 1",
    "kv_get_by_ids": f"SELECT chunk_id, md5(content) AS content_md5 FROM {S.CHUNKS} WHERE chunk_id IN (SELECT unnest(source_ids) FROM entities)",
    "kv_filter_missing": "SELECT DISTINCT x AS chunk_id FROM (SELECT unnest(source_ids) AS x FROM entities) WHERE x IS NOT NULL AND x NOT IN (SELECT chunk_id FROM chunks)",
    "kv_missing_repeated": "SELECT x AS chunk_id, count(*) AS n FROM (SELECT unnest(source_ids) AS x FROM entities) WHERE x IS NOT NULL AND x NOT IN (SELECT chunk_id FROM chunks) GROUP BY 1",
    "kv_upsert": f"""SELECT chunk_id, doc_id, created_at, md5(content) AS content_md5 FROM {S.CHUNKS}
      UNION ALL SELECT chunk_id, doc_id, created_at, md5(content) FROM pinned_chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks)""",
    "kv_delete": f"SELECT chunk_id, doc_id FROM {S.CHUNKS} WHERE doc_id NOT IN (SELECT doc_id FROM {S.STATUS} WHERE status = 'failed')",
    "kv_count": "SELECT namespace, count(DISTINCT id) AS n FROM vector_index GROUP BY 1",
    "fetch_ordered": f"""SELECT l.doc_id, CAST(l.pos - 1 AS INT) AS pos, l.chunk_id, CAST(strlen(c.content) AS INT) AS n_bytes
      FROM (SELECT doc_id, unnest(chunks_list) AS chunk_id, generate_subscripts(chunks_list, 1) AS pos FROM {S.STATUS}) l JOIN {S.CHUNKS} c USING (chunk_id) WHERE len({S.fields('c.content')}) > 0""",
    "fetch_with_gaps": f"""SELECT l.doc_id, CAST(l.pos - 1 AS INT) AS pos, l.chunk_id, CAST(strlen(coalesce(c.content, '')) AS INT) AS n_bytes
      FROM (SELECT doc_id, unnest(chunks_list) AS chunk_id, generate_subscripts(chunks_list, 1) AS pos FROM {S.STATUS}) l LEFT JOIN {S.CHUNKS} c USING (chunk_id)""",
}
