"""Per-document status: content-addressed enqueue and a four-state machine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import store

# The states and the allowed transitions between them.
STATES = ["pending", "processing", "processed", "failed"]
TRANSITIONS = [("pending", "processing"), ("pending", "failed"), ("processing", "processed"), ("processing", "failed"), ("failed", "processing")]


class InvalidTransition(ValueError):
    """A status change that the machine does not allow."""


def transition_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "from_status string, to_status string")


def is_valid(source: Column, target: Column) -> Column:
    return reduce(Column.__or__, [(source == a) & (target == b) for a, b in TRANSITIONS])


def enqueue(existing: DataFrame, docs: DataFrame, text: str, path: str, seq: str, now: Column) -> DataFrame:
    """New pending rows for contents that are not yet known.

    The first of equal contents (by ``seq``) wins; known ids stay as they are.
    """
    first = docs.filter(F.col(text).isNotNull()).groupBy(T.content_id(F.col(text)).alias("doc_id")).agg(
        F.min_by(F.struct(T.summary(F.col(text)).alias("content_summary"), F.octet_length(text).alias("content_length"), F.col(path).alias("file_path")), seq).alias("d"))
    return (first.join(existing.select("doc_id"), "doc_id", "left_anti")
            .select("doc_id", "d.*", F.lit("pending").alias("status"), now.alias("created_at"), now.alias("updated_at")))


def transition(statuses: DataFrame, changes: DataFrame, now: Column, strict: bool = True) -> DataFrame:
    """Applies one change per document: ``changes`` has ``doc_id, to_status`` and optionally ``chunks_list, error_msg``.

    Strict mode raises on an unknown document or a forbidden change, otherwise
    such changes are ignored.  The error of an earlier failure is kept.
    """
    extra = [c for c in ("chunks_list", "error_msg") if c in changes.columns]
    new = changes.select("doc_id", "to_status", *[F.col(c).alias(f"_{c}") for c in extra])
    joined = statuses.join(new, "doc_id", "left")
    if strict:
        bad = new.join(statuses.select("doc_id", "status"), "doc_id", "left").filter(~F.coalesce(is_valid(F.col("status"), F.col("to_status")), F.lit(False))).limit(1).collect()
        if bad:
            raise InvalidTransition(f"{bad[0]['doc_id']}: {bad[0]['status']} -> {bad[0]['to_status']}")
    ok = F.coalesce(is_valid(F.col("status"), F.col("to_status")), F.lit(False))
    out = joined.withColumn("_ok", ok).withColumn("status", F.when(F.col("_ok"), F.col("to_status")).otherwise(F.col("status")))
    out = out.withColumn("updated_at", F.when(F.col("_ok"), now).otherwise(F.col("updated_at")))
    for c in extra:
        out = out.withColumn(c, F.when(F.col("_ok"), F.coalesce(f"_{c}", c)).otherwise(F.col(c)))
    if "chunks_list" in extra and "chunks_count" in statuses.columns:
        out = out.withColumn("chunks_count", F.when(F.col("_ok"), F.size("chunks_list")).otherwise(F.col("chunks_count")))
    return out.select(*statuses.columns)


def by_status(statuses: DataFrame, *wanted: str) -> DataFrame:
    """Documents in one of the given states; with none given, those a resumed run has to take up."""
    return statuses.filter(F.col("status").isin(*(wanted or ("pending", "processing", "failed"))))


def current(rows: DataFrame) -> DataFrame:
    """The latest delivery of each document."""
    return store.latest(rows, "doc_id", "updated_at", "created_at")


def fold(events: DataFrame, key: str, target: Column, order: list[str], bucket: Column, start: str = "pending") -> DataFrame:
    """``key, status, applied``: the state after all events in order, and how many were allowed.

    An event maps each state to the next one; maps compose associatively, so the
    events of a key are composed per ``bucket`` (a monotone function of the order)
    first and the few bucket maps then in order.  No task holds all events of a key.
    """
    state = {s: i for i, s in enumerate(STATES)}
    may = {t: [a for a, b in TRANSITIONS if b == t] for t in STATES}

    def step(maps: Column, t: Column) -> Column:
        # maps[i] is (state now, changes so far) when the bucket was entered in state i.
        def one(m: Column) -> Column:
            ok = reduce(Column.__or__, [(t == F.lit(b)) & m["s"].isin(a) for b, a in may.items() if a])
            return F.struct(F.when(ok, t).otherwise(m["s"]).alias("s"), (m["n"] + F.when(ok, 1).otherwise(0)).cast("long").alias("n"))

        return F.transform(maps, one)

    identity = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(0).cast("long").alias("n")) for s in STATES])
    rows = events.select(key, bucket.alias("_bucket"), F.struct(*order, target.alias("_t")).alias("e")).filter(F.col("e._t").isNotNull())
    maps = rows.groupBy(key, "_bucket").agg(F.aggregate(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["_t"]), identity, step).alias("maps"))
    place = F.create_map(*[F.lit(x) for kv in state.items() for x in kv])
    first = F.struct(F.lit(start).alias("s"), F.lit(0).cast("long").alias("n"))

    def enter(s: Column, b: Column) -> Column:
        m = F.get(b["maps"], F.element_at(place, s["s"]))
        return F.struct(m["s"].alias("s"), (s["n"] + m["n"]).alias("n"))

    final = maps.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("_bucket", "maps"))), first, enter).alias("f"))
    return final.select(key, F.col("f.s").alias("status"), F.col("f.n").alias("applied"))
