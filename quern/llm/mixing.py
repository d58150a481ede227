"""Mixing sources to target weights.

The texts of a source, in a pseudorandom order, form one stream of tokens, cut
into blocks of ``BLOCK`` tokens.  Each source gets the
number of blocks that makes up its share of the output.  For every output shard of
``SHARD_SLOTS`` slots the counts of the sources are drawn from a multinomial
distribution of the target shares.  The slots of a source are numbered over all
shards and sent through a pseudorandom permutation; as many as the source is to have
keep their source, and the few beyond, spread over all shards, go to the sources that
were drawn too rarely, so that the totals are exact.  The number then goes through a
permutation of the source's blocks, a fresh one for every repetition, and slots and
blocks are joined by that index: a block, and so any token of a text, is used at most
``max_repeats`` times.  Shards are drawn in at most ``GROUPS`` groups, whose counts
are all that is collected.

The total is the largest for which no source needs more repetitions than it may
have.  Sources without texts are left out and the other shares scaled up; the
shares reached are reported beside the targets.  A text that occurs several times
counts once, for its smallest ``doc_id``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.tokens import RANK_FILE, token_sizes
from quern.sources.tables import materialise

#: Tokens of a block: small against the rarest source, so that its last, shorter block weighs little.
BLOCK, SHARD_SLOTS, BUCKET_TEXTS, GROUPS = 256, 1024, 5_000, 4096


def permute(index: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A keyed permutation of ``range(size)``, element-wise: Feistel rounds with cycle walking."""
    index, size, seed = (np.asarray(x).astype(np.uint64) for x in (index, size, seed))
    size, seed = np.broadcast_to(size, index.shape), np.broadcast_to(seed, index.shape)
    half = np.ceil(np.log2(np.maximum(size.astype(np.float64), 2)) / 2).astype(np.uint64)
    half = np.where((np.uint64(1) << (half * np.uint64(2))) < size, half + np.uint64(1), half)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.copy(), np.ones(index.shape, bool)
    with np.errstate(over="ignore"):
        while todo.any():
            h, m, s = half[todo], mask[todo], seed[todo]
            left, right = out[todo] >> h, out[todo] & m
            for r in range(4):
                f = (right + s * np.uint64(2 * r + 1) + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f >> np.uint64(33)) & m)
            out[todo] = (left << h) | right
            todo = out >= size
    return out.astype(np.int64)


def _stream(documents: DataFrame, targets: DataFrame, rank_file: str, block: int) -> DataFrame:
    """``source, doc_id, n_tokens, first``: the place of each distinct text in its source's stream."""
    once = (documents.select("doc_id", "source", "text").filter("text <> ''").groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("l"))
            .agg(F.min_by(F.struct("doc_id", "source", "text"), "doc_id").alias("d")).select("d.*"))
    wanted = once.join(targets.select("source").distinct(), "source", "left_semi")
    sized = materialise(token_sizes(wanted, ["doc_id", "source"], "text", rank_file), "mixing-sizes")
    counts = sized.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BUCKET_TEXTS).alias("buckets"))
    # Prefix sums in two levels: buckets of a source, then texts of a bucket; no task holds a source.
    spread = sized.join(counts, "source").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.col("buckets")))
    sums = spread.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("source", "bucket", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return (spread.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(before, ["source", "bucket"])
            .select("source", "doc_id", "n_tokens", (F.col("before") + F.col("inside")).alias("first")))


def plan(sizes: dict[str, int], targets: list[tuple[str, float, int]], block: int = BLOCK) -> dict[str, tuple[int, int]]:
    """Blocks available and blocks drawn of every present source.

    ``sizes``: tokens of each source.  Shares of absent sources go to the others
    in proportion.
    """
    there = {s: (w, max(1, r), -(-sizes[s] // block)) for s, w, r in targets if sizes.get(s) and w and w > 0}
    whole = sum(w for w, _, _ in there.values())
    if not there:
        return {}
    total = min(sizes[s] * r / (w / whole) for s, (w, r, _) in there.items())
    # The last block of a source is shorter; its average block decides how many make up its share.
    return {s: (n, min(round(total * w / whole * n / sizes[s]), n * r)) for s, (w, r, n) in there.items()}


def shard_counts(shard: int, total: int, shares: np.ndarray, seed: int) -> np.ndarray:
    """The multinomial draw of an output shard: slots of each source."""
    return np.random.default_rng([seed, shard]).multinomial(min(SHARD_SLOTS, total - shard * SHARD_SLOTS), shares)


def _slots(spark: SparkSession, names: list[str], available: np.ndarray, wanted: np.ndarray, seed: int) -> DataFrame:
    """``shard_no, slot_no, source, repetition, block_no`` of every output slot."""
    total = int(wanted.sum())
    shards = -(-total // SHARD_SLOTS)
    size = max(1, -(-shards // GROUPS))
    groups = -(-shards // size)
    share = wanted / max(total, 1)

    def drawn(group: int) -> np.ndarray:
        return np.stack([shard_counts(i, total, share, seed) for i in range(group * size, min((group + 1) * size, shards))])

    def sums(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "n": [drawn(int(g)).sum(axis=0).tolist() for g in pdf["id"]]})

    kind = "shard_no long, slot_no long, source string, repetition long, block_no long"
    if not total:
        return spark.createDataFrame([], kind)
    counted = {r["id"]: r["n"] for r in spark.range(groups).mapInPandas(sums, "id long, n array<long>").collect()}  # at most GROUPS rows
    table = np.array([counted[g] for g in range(groups)], np.int64)
    before, got = np.cumsum(table, axis=0) - table, table.sum(axis=0)
    over, under = np.maximum(got - wanted, 0), np.maximum(wanted - got, 0)

    def draw(batches):
        for pdf in batches:
            for group in pdf["id"]:
                counts = drawn(int(group))
                start = before[group] + np.cumsum(counts, axis=0) - counts
                for shard, n, first in zip(range(int(group) * size, shards), counts, start):
                    which = np.repeat(np.arange(len(n)), n)
                    number = first[which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]
                    number = permute(number, got[which], seed + 7 + which)
                    spare = number >= wanted[which]
                    # The k-th slot drawn too often, over all sources, is the k-th that some source lacks.
                    k = (np.cumsum(over) - over)[which[spare]] + number[spare] - wanted[which[spare]]
                    to = np.searchsorted(np.cumsum(under), k, side="right")
                    number[spare] = got[to] + k - (np.cumsum(under) - under)[to]
                    which[spare] = to
                    times, index = number // available[which], number % available[which]
                    place = permute(np.arange(len(which)), np.int64(len(which)), np.int64(seed + shard))
                    yield pd.DataFrame({"shard_no": shard, "slot_no": shard * SHARD_SLOTS + place, "source": [names[i] for i in which], "repetition": times,
                                        "block_no": permute(index, available[which], seed + 1 + which + times * len(names))})

    return spark.range(groups).mapInPandas(draw, kind)


def mix(documents: DataFrame, targets: DataFrame, rank_file: str = RANK_FILE, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """``shard_no, slot_no, source, repetition, doc_id, first_token, n_tokens`` of the selection."""
    spark = documents.sparkSession
    # One row per source in the targets, a fixed small table.
    wanted = [(r["source"], r["target_share"], r["max_repeats"] or 1) for r in targets.filter("source is not null and target_share > 0").collect()]
    stream = materialise(_stream(documents, targets, rank_file, block), "mixing-stream")
    sizes = {r["source"]: r["t"] for r in stream.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    drawn = plan(sizes, wanted, block)
    names = sorted(drawn)
    available, wanted_slots = (np.array([drawn[s][i] for s in names], np.int64) for i in (0, 1))
    slots = _slots(spark, names, available, wanted_slots, seed)
    last = F.floor((F.col("first") + F.col("n_tokens") - 1) / block)
    parts = stream.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("first") / block), last)))
    begin = F.greatest(F.col("first"), F.col("block_no") * block)
    end = F.least(F.col("first") + F.col("n_tokens"), (F.col("block_no") + 1) * block)
    parts = parts.select("source", "block_no", "doc_id", (begin - F.col("first")).alias("first_token"), (end - begin).alias("n_tokens"))
    return slots.join(parts, ["source", "block_no"]).select("shard_no", "slot_no", "source", "repetition", "doc_id", "first_token", "n_tokens")


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, n_tokens, reached_share, most_uses`` of every target source."""
    used = selection.groupBy("source", "doc_id", "first_token").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("uses"))
    by = used.groupBy("source").agg(F.sum("t").alias("n_tokens"), F.max("uses").alias("most_uses"))
    whole = by.agg(F.sum("n_tokens").alias("all"))
    out = targets.join(by, "source", "left").crossJoin(F.broadcast(whole))  # one row
    return out.select("source", "target_share", "max_repeats", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
                      F.round(F.coalesce(F.col("n_tokens") / F.col("all"), F.lit(0.0)), 6).alias("reached_share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))


def shard_shares(selection: DataFrame) -> DataFrame:
    """``shard_no, source, n_slots, share, deviation``: the sources of each output shard, and how far they are from their share of all slots."""
    by = selection.select("shard_no", "slot_no", "source").distinct().groupBy("shard_no", "source").agg(F.count(F.lit(1)).alias("n_slots"))
    whole = by.groupBy("shard_no").agg(F.sum("n_slots").alias("all"))
    overall = by.groupBy("source").agg(F.sum("n_slots").alias("m"))
    every = by.agg(F.sum("n_slots").alias("every"))
    share = F.col("n_slots") / F.col("all")
    return (by.join(whole, "shard_no").join(F.broadcast(overall), "source").crossJoin(F.broadcast(every))  # one row a source; one row
            .select("shard_no", "source", "n_slots", F.round(share, 6).alias("share"), F.round(share - F.col("m") / F.col("every"), 6).alias("deviation")))
