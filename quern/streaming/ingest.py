"""Incremental ingestion: new document files to status, chunks and vectors.

Each micro-batch is enqueued by content hash, chunked, embedded and appended to
snapshot tables, the status last.  A batch writes its own rows only; what it wrote
under its number before a failure is replaced when it runs again, so nothing is
doubled.  Tables of many batches are compacted now and then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions import embed
from quern.functions import text as T
from quern.operators import chunking, docstatus
from quern.sources.snapshots import Snapshots
from quern.sources.tables import materialise, release

STATUS = "doc_id string, content_summary string, content_length int, file_path string, status string, created_at timestamp, updated_at timestamp, chunks_count int"
CHUNKS = "chunk_id string, doc_id string, content string, tokens int, chunk_order_index int"
INDEX = "id string, vector array<float>"


def ingest_batch(batch: DataFrame, number: int, root: str, size: int = 1200, overlap: int = 100, dim: int = 64, most_parts: int = 16) -> int:
    """Ingests the documents (``text, file_path``) of one batch; returns how many were new."""
    spark, tag = batch.sparkSession, f"batch_{number}"
    statuses, chunks, index = (Snapshots(spark, root, n) for n in ("doc_status", "chunks", "vectors"))
    known = statuses.read(STATUS)
    rows = batch.select("text", "file_path", F.coalesce("file_path", F.lit("")).alias("_seq")).filter(~T.is_blank(F.col("text")))
    fresh = materialise(docstatus.enqueue(known, rows, "text", "file_path", "_seq", F.current_timestamp()), "ingest-fresh")
    texts = rows.groupBy(T.content_id(F.col("text")).alias("doc_id")).agg(F.first("text").alias("text")).join(fresh.select("doc_id"), "doc_id", "left_semi")
    cut = chunking.by_tokens(texts, "doc_id", "text", size, overlap).select(
        T.chunk_id(F.col("id"), F.col("chunk_order_index")).alias("chunk_id"), F.col("id").alias("doc_id"), "content", "tokens", "chunk_order_index")
    cut = materialise(cut, "ingest-chunks")
    chunks.append(cut, tag)
    index.append(cut.select(F.col("chunk_id").alias("id"), embed.counter(F.col("content"), dim).cast("array<float>").alias("vector")), tag)
    counts = cut.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("chunks_count"))
    done = fresh.join(counts, "doc_id").withColumn("status", F.lit("processed"))
    statuses.append(done.select(*known.columns), tag)
    new = fresh.count()
    release(fresh, cut)
    for table, schema in ((statuses, STATUS), (chunks, CHUNKS), (index, INDEX)):
        table.compact(schema, most_parts)
    return new


def ingest(spark: SparkSession, source: str, schema: str, root: str, checkpoint: str, available_now: bool = True, **options) -> StreamingQuery:
    """Starts a query over a folder of Parquet files with ``text`` and ``file_path``."""
    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, number: ingest_batch(df, number, root, **options))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Counts per kind and window of a stream or table of events, late rows dropped after the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, every), kind).agg(F.count(F.lit(1)).alias("n"))
