"""Per-key results on skewed keys by exact offset chunking.

A few keys may hold most rows.  Grouping by the key would send all rows of such a
key to one task; grouping with partial aggregation is fine for sums but not for
ordered or list-valued results.  Exact offset chunking has five steps:

1. count the rows of every key in every input partition (a partial aggregate,
   so at most one row per key and partition is shuffled);
2. prefix-sum those counts over the partitions of a key: every partition then
   knows the number of its first row of the key;
3. number the rows of a partition locally, so every row has its exact number
   within its key;
4. cut each key into chunks of ``chunk_rows`` rows, aggregated independently;
5. merge the chunk states (count, sum, first and last row) in chunk order.

Where the result follows an order of its own, the rows are range-partitioned by key
and order first.  Then only the first key of a partition can have begun in an
earlier one, so that the offsets of step 2 are one row a partition.

No task ever receives more than one chunk of a key, apart from the step-2 counts
(one row per partition that holds the key) and the step-5 states (one per chunk).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.tables import materialise

#: Rows of a key that one task processes together.
CHUNK_ROWS = 20_000


def _tag(df: DataFrame, key: str) -> DataFrame:
    """Adds the input partition of each row, unless ``_pid`` is given; null and empty keys are dropped.

    The source must read the same rows into the same partitions when it is
    computed twice, which holds for file scans.
    """
    kept = df.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    return kept if "_pid" in df.columns else kept.withColumn("_pid", F.spark_partition_id())


def key_offsets(df: DataFrame, key: str) -> DataFrame:
    """Step 1 and 2: ``(_pid, key, _n, _offset, _total)``.

    ``_offset`` is the number of rows of the key in earlier partitions, ``_total``
    the number in all.  An empty input gives no rows.
    """
    counts = _tag(df, key).groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(key)
    upto = by_key.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        "_pid", key, "_n",
        F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_offset"),
        F.sum("_n").over(by_key).alias("_total"),
    )


def key_chunk_counts(df: DataFrame, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(key, chunk_no, n)``: the number of rows of each chunk of each key.

    Derived from the offsets alone, rows are not moved: a partition that holds
    rows ``offset .. offset + n`` of a key contributes to the chunks these touch.
    """
    first = F.floor(F.col("_offset") / chunk_rows)
    last = F.floor((F.col("_offset") + F.col("_n") - 1) / chunk_rows)
    spans = key_offsets(df, key).select(
        key, "_offset", "_n", F.explode(F.sequence(first, last)).alias("chunk_no"))
    low = F.greatest(F.col("_offset"), F.col("chunk_no") * chunk_rows)
    high = F.least(F.col("_offset") + F.col("_n"), (F.col("chunk_no") + 1) * chunk_rows)
    return spans.groupBy(key, "chunk_no").agg(F.sum(high - low).alias("n"))


def key_totals(df: DataFrame, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(key, n)``: the chunk states of each key merged to its row count."""
    return key_chunk_counts(df, key, chunk_rows).groupBy(key).agg(F.sum("n").cast("long").alias("n"))


def numbered(df: DataFrame, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every row with its exact number within its key and its chunk.

    Adds ``key_row`` (from 0) and ``chunk_no``.  Rows are numbered in the order of
    the input: its partitions, and the place in them, which is taken before anything
    is moved.  They are then grouped by partition and key, a group no larger than an
    input partition, which spreads a hot key over as many tasks as partitions hold it.
    """
    tagged = _tag(df, key).withColumn("_at", F.monotonically_increasing_id())
    offsets = key_offsets(df, key).select("_pid", key, "_offset")
    within = Window.partitionBy("_pid", key).orderBy("_at")
    placed = tagged.join(offsets, ["_pid", key]).withColumn("key_row", F.col("_offset") + F.row_number().over(within) - 1)
    return placed.withColumn("chunk_no", F.floor(F.col("key_row") / chunk_rows)).select(*df.columns, "key_row", "chunk_no")


def _count_within(key: str):
    """Numbers the rows of each key in a partition that is sorted by key; adds the partition's number."""
    def run(batches):
        from pyspark import TaskContext

        pid, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(key)
            fresh = np.r_[k[0].as_py() != last, pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)].astype(bool)
            starts = np.flatnonzero(fresh)
            # Rows before the first new key go on with the last one of the batch before.
            at = np.arange(len(k))
            begin = np.where(np.cumsum(fresh) > 0, starts[np.maximum(np.cumsum(fresh) - 1, 0)] if len(starts) else 0, -n)
            local = at - begin
            last, n = k[-1].as_py(), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(k), pid, np.int32)), pa.array(local.astype(np.int64))], names=[*batch.schema.names, "_pid", "_local"])

    return run


def numbered_in_order(df: DataFrame, key: str, order: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every row with its exact number within its key by ``order``, and its chunk.

    Adds ``key_row`` (from 0) and ``chunk_no``; null and empty keys are dropped.
    ``order`` should be unique within a key: rows that agree in it stay in one
    partition, and their numbers are not repeatable.
    """
    kept = df.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    local = kept.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(_count_within(key), f"{fields}, _pid int, _local long")
    ranged = materialise(local, "hotkeys-ranged")
    # One row a partition: its first key, its last key and how many rows of that it has.
    edges = sorted(ranged.groupBy("_pid").agg(F.min(key).alias("first"), F.max(F.struct(F.col(key).alias("k"), "_local")).alias("e")).collect())
    offsets, carried, before = [], 0, None
    for pid, first, end in edges:
        begun = carried if before == first else 0
        if begun:
            offsets.append((pid, first, begun))
        carried, before = end["_local"] + 1 + (begun if end["k"] == first else 0), end["k"]
    known = df.sparkSession.createDataFrame(offsets, f"_pid int, `{key}` string, _offset long")
    whole = ranged.join(F.broadcast(known), ["_pid", key], "left").withColumn("key_row", F.col("_local") + F.coalesce("_offset", F.lit(0)))
    return whole.withColumn("chunk_no", F.floor(F.col("key_row") / chunk_rows)).select(*df.columns, "key_row", "chunk_no")


def chunked_aggregate(df: DataFrame, key: str, weight: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per-key row count and summed weight, from chunk states merged in order.

    Returns ``key, n, sum_weight, chunks``.  A null weight adds nothing; a key
    whose weights are all null has a null sum.
    """
    rows = numbered(df.select(key, *([weight] if weight else [])), key, chunk_rows)
    # Sums are taken in thousandths so the result does not depend on the order of addition.
    value = F.round(F.col(weight) * 1000).cast("long") if weight else F.lit(None).cast("long")
    states = rows.groupBy(key, "chunk_no").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("w"))
    return states.groupBy(key).agg(
        F.sum("n").alias("n"), (F.sum("w") / 1000).alias("sum_weight"), F.count(F.lit(1)).alias("chunks"))


def ordered_chunks(df: DataFrame, key: str, order: str, weight: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The chunks of each key by ``order`` with their boundary states.

    Returns ``key, chunk_no, n, sum_weight, first, last, weight_before``: the rows and
    weight of the chunk, the first and last value of ``order`` in it, and the weight
    of all chunks of the key before it, from which any running total follows within
    the chunk.  A null weight adds nothing.
    """
    rows = numbered_in_order(df.select(key, order, weight), key, [order], chunk_rows)
    value = F.coalesce(F.round(F.col(weight) * 1000).cast("long"), F.lit(0))
    states = rows.groupBy(key, "chunk_no").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("w"), F.min(order).alias("first"), F.max(order).alias("last"))
    # A key has a row a chunk left.
    before = F.coalesce(F.sum("w").over(Window.partitionBy(key).orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return states.select(key, "chunk_no", "n", (F.col("w") / 1000).alias("sum_weight"), "first", "last", (before / 1000).alias("weight_before"))


def merged_lists(df: DataFrame, key: str, array: str, segment: int = 1000) -> DataFrame:
    """The distinct elements of ``array`` over the rows of each key, in segments.

    Returns ``key, segment_no, n_elements, elements``: segment ``i`` holds the
    elements numbered ``i * segment ..`` of the key in code-point order, so the
    segments one after the other are the merged list.  A key of a third of all
    rows thus gives many rows of bounded size, never one unbounded list.  Null or
    empty arrays and elements add nothing.
    """
    pairs = (df.filter(F.col(key).isNotNull() & (F.col(key) != ""))
             .select(key, F.explode(array).alias("element")).filter(F.col("element").isNotNull() & (F.col("element") != "")).distinct())
    return (numbered_in_order(pairs, key, ["element"], segment).groupBy(key, F.col("chunk_no").alias("segment_no"))
            .agg(F.array_sort(F.collect_list("element")).alias("elements"))
            .select(key, "segment_no", F.size("elements").alias("n_elements"), "elements"))


def heavy_keys(df: DataFrame, key: str, share: float = 0.02, of: DataFrame | None = None) -> DataFrame:
    """``(key, n)`` of the keys that hold at least ``share`` of all rows.

    Counts come from :func:`chunked_aggregate`.  ``of`` is the table whose rows are the
    whole (``df`` itself by default); null and empty keys are part of the whole
    but never of the result.  An empty table gives no rows.
    """
    whole = (of if of is not None else df).agg(F.count(F.lit(1)).alias("_rows"))
    return (chunked_aggregate(df, key).crossJoin(F.broadcast(whole))  # one row
            .filter(F.col("n") >= F.col("_rows") * F.lit(share)).select(key, "n"))
