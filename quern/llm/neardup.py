"""Near-equal texts by pigeonring filtering.

Similarity is the Jaccard index of the sets of word shingles.  Two sets of sizes
``x`` and ``y`` have an index of at least ``t`` exactly if the Hamming distance of
their indicator vectors is at most ``(x + y) (1 - t) / (1 + t)``.

Each text gets a ring of segments of min-wise hashes (:func:`ring`).  A value
differs between two texts with probability ``1 - J``, so the number of differing
values over the ring estimates the distance.  The stages are

1. candidates: pairs with no difference in at least one segment, found by an
   equi-join on (segment, values) - never by comparing all pairs;
2. the pigeonring test: if the differences over the whole ring are at most
   ``budget``, then some chain of consecutive segments has, for every prefix of
   ``l`` segments, at most ``l * budget / segments`` differences.  Pairs without
   such a chain are pruned; a pair within the budget never is.  The signatures
   travel with the members of a key that several texts share, so that the test is
   made where pairs arise and only survivors are written;
3. the full Hamming check on the shingle sets of the whole texts.

The first step asks for a segment without any difference although a chain may begin
with ``budget / segments`` of them: an equi-join needs equal values, and joining on
single values instead would make almost any two texts candidates.  So a pair is
found with a probability.  With 24 segments of 3 values a pair of similarity 0.5 /
0.55 / 0.6 / 0.7 becomes a candidate with 0.959 / 0.987 / 0.997 / 0.99995; with 16
of 4, used from a similarity of 0.75 on, one of 0.75 / 0.8 / 0.85 with 0.998 /
0.9998 / 0.999997.

Skew: exact copies are one class, made before anything else by a 128-bit digest of
the text, and all that follows works on one text a class.  Keys are first counted
with partial aggregation, keys of one text are dropped, keys of two need no list;
members of larger ones are cut into blocks of ``BLOCK`` and compared block by block,
so that no task holds a whole key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import wordhash
from quern.sources.tables import materialise, release, spread

BLOCK = 64
#: In :func:`near_duplicates` exact copies up to this number are given as all their pairs, larger classes as a star.
MAX_COPIES = 200
#: Classes of at least one in so many ids are joined by broadcast: there are no more than this.
HOT = 1000
#: Pairs tested at once.
_AT_ONCE = 50_000


def ring(threshold: float) -> tuple[int, int]:
    """Segments, and values of each, for a similarity."""
    return (16, 4) if threshold >= 0.75 else (24, 3)


def _features(k: int, min_words: int, segments: int, rows: int):
    """Band keys and packed 4-bit signatures of the texts with enough words."""
    values = segments * rows
    odd = (np.random.default_rng(20).integers(1, 2**63, values, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    def run(batches):
        table = wordhash.alnum_table()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            words, counts = wordhash.word_hashes(texts, table)
            runs, doc = wordhash.run_hashes(words, counts, k)
            keep = counts[doc] >= min_words
            runs, doc = runs[keep], doc[keep]
            if not len(runs):
                continue
            starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            sig = np.empty((len(starts), values), np.uint64)
            with np.errstate(over="ignore"):
                for i in range(values):
                    sig[:, i] = np.minimum.reduceat((runs * odd[i]) >> np.uint64(16), starts)
                keys = np.empty((len(starts), segments), np.uint64)
                for s in range(segments):
                    h = np.full(len(starts), s + 1, np.uint64)
                    for r in range(rows):
                        h = wordhash.mix64(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, s * rows + r])
                    keys[:, s] = h
            low = (wordhash.mix64(sig) & np.uint64(15)).astype(np.uint8)
            packed = (low[:, ::2] << 4) | low[:, 1::2]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c).take(pa.array(doc[starts])) for c in ("cid", "h")),
                pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * segments), pa.array(keys.ravel().view(np.int64))),
                pa.array([x.tobytes() for x in packed], pa.binary()),
            ], names=["cid", "h", "keys", "sig"])

    return run


def _unpacked(raw: list[bytes], width: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width)
    out = np.empty((len(packed), 2 * width), np.uint8)
    out[:, ::2], out[:, 1::2] = packed >> 4, packed & 15
    return out


def _in_chain(left: np.ndarray, right: np.ndarray, segments: int, rows: int, budget: int) -> np.ndarray:
    """Whether some chain of segments keeps its running differences in the budget."""
    limit = budget / segments * np.arange(1, segments + 1) + 1e-9
    differ = (left != right).reshape(-1, segments, rows).sum(2, dtype=np.int16)
    found = differ.sum(axis=1) <= budget  # such a pair always has a chain
    rest = np.flatnonzero(~found)
    for start in range(segments):
        own = differ[rest]
        ok = (np.cumsum(np.roll(own, -start, axis=1), axis=1) <= limit).all(axis=1)
        found[rest[ok]] = True
        rest = rest[~ok]
    return found


def _chain(segments: int, rows: int, budget: int):
    """Keeps pairs with a chain."""
    width = segments * rows // 2

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = pa.array(_in_chain(_unpacked(batch.column("sig_a").to_pylist(), width), _unpacked(batch.column("sig_b").to_pylist(), width), segments, rows, budget))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(found), batch.column("b").filter(found)], names=["a", "b"])

    return run


def _chain_blocks(segments: int, rows: int, budget: int):
    """Pairs with a chain out of two lists of members a row."""
    width = segments * rows // 2

    def side(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = batch.column(name)
        flat = lists.flatten()
        return flat.field("cid").to_numpy(zero_copy_only=False), _unpacked(flat.field("sig").to_pylist(), width), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

    def run(batches):
        for whole in batches:
            # A row has at most BLOCK * BLOCK pairs.
            for at in range(0, whole.num_rows, max(_AT_ONCE // (BLOCK * BLOCK), 1)):
                batch = whole.slice(at, max(_AT_ONCE // (BLOCK * BLOCK), 1))
                (u, su, nu), (v, sv, nv) = side(batch, "us"), side(batch, "vs")
                pairs = nu * nv
                row = np.repeat(np.arange(len(nu)), pairs)
                within = np.arange(len(row)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
                i, j = (np.cumsum(nu) - nu)[row] + within // np.maximum(nv, 1)[row], (np.cumsum(nv) - nv)[row] + within % np.maximum(nv, 1)[row]
                i, j = i[u[i] < v[j]], j[u[i] < v[j]]
                found = _in_chain(su[i], sv[j], segments, rows, budget)
                yield pa.RecordBatch.from_arrays([pa.array(u[i[found]]), pa.array(v[j[found]])], names=["a", "b"])

    return run


def _hamming(k: int, threshold: float):
    """The full check: Hamming distance of the two shingle sets against its bound."""

    def run(batches):
        table = wordhash.alnum_table()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            texts = batch.column("text_a").to_pylist() + batch.column("text_b").to_pylist()
            words, counts = wordhash.word_hashes(texts, table)
            runs, doc = wordhash.run_hashes(words, counts, k)
            order = np.lexsort((runs, doc))
            runs, doc = runs[order], doc[order]
            fresh = np.r_[True, (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])] if len(runs) else np.zeros(0, bool)
            runs, doc = runs[fresh], doc[fresh]
            sizes = np.bincount(doc, minlength=2 * n)
            pair = doc % n
            order = np.lexsort((runs, pair))
            runs, pair = runs[order], pair[order]
            both = (runs[1:] == runs[:-1]) & (pair[1:] == pair[:-1])
            shared = np.bincount(pair[1:][both], minlength=n)
            total = sizes[:n] + sizes[n:]
            distance = total - 2 * shared
            found = pa.array(distance <= total * (1 - threshold) / (1 + threshold) + 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(found) for c in ("a", "b")]
                                             + [pa.array(shared / np.maximum(total - shared, 1)).filter(found)], names=["a", "b", "similarity"])

    return run


def _crowded(features: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pairs of the keys that two members share, and the members of larger keys in pairs of blocks: ``us, vs``.

    A block pair of one block with itself has all its members in both lists.
    """
    keyed = features.select(F.explode("keys").alias("key"), "cid")
    counted = keyed.groupBy("key").agg(F.min("cid").alias("a"), F.max("cid").alias("b"), F.count(F.lit(1)).alias("n")).filter("a < b")
    two = counted.filter("n = 2").select("a", "b")
    # Larger keys: members are numbered into blocks by hash; each pair of blocks is a task's worth of work.
    many = counted.filter("n > 2").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    member = keyed.join(many, "key").distinct().withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    if payload:
        member = member.join(features.select("cid", *payload), "cid")
    shown = F.struct("cid", *payload) if payload else F.col("cid")
    left = member.select("key", shown.alias("m"), F.col("block").alias("g"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("h"))
    left = left.select("key", "m", F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"), (F.col("g") <= F.col("h")).alias("low"), (F.col("g") >= F.col("h")).alias("high"))
    return two, left.groupBy("key", "g", "h").agg(F.collect_list(F.when(F.col("low"), F.col("m"))).alias("us"), F.collect_list(F.when(F.col("high"), F.col("m"))).alias("vs"))


def _candidates(features: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of ``cid`` that agree in one of ``keys``."""
    two, both = _crowded(features, [])
    crossed = both.select(F.explode("us").alias("u"), "vs").select("u", F.explode("vs").alias("v")).filter("u <> v")
    return two.unionByName(crossed.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))).distinct()


def _chained(features: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs ``a < b`` of classes that agree in a segment and pass the pigeonring test."""
    segments, rows = ring(threshold)
    values = segments * rows
    # The expected share of differing values at the threshold plus three deviations.
    budget = int(values * (1 - threshold) + 3 * (values * threshold * (1 - threshold)) ** 0.5)
    two, both = _crowded(features, ["sig"])
    sig = features.select("cid", "sig")
    signed = (two.distinct().join(sig.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a")), "a")
              .join(sig.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b")), "b"))
    few = signed.mapInArrow(_chain(segments, rows, budget), "a long, b long")
    # A pair of two blocks comes in either order.
    crossed = both.select("us", "vs").unionByName(both.filter("g <> h").select(F.col("vs").alias("us"), F.col("us").alias("vs"))).mapInArrow(_chain_blocks(segments, rows, budget), "a long, b long")
    return few.unionByName(crossed).distinct()


def _classes(rows: DataFrame) -> DataFrame:
    """``cid, h, text``: each text once, with a number and its digest; ``rows`` has ``h, text``."""
    return materialise(rows.groupBy("h").agg(F.first("text").alias("text")).withColumn("cid", F.monotonically_increasing_id()), "neardup-classes")


def _digested(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, h`` of the rows with an id; the digest is null for a null text."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null").withColumn("h", F.unhex(F.md5("text")))


def similar_classes(classes: DataFrame, k: int = 5, threshold: float = 0.8, min_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """The classes with enough words, ``cid, h``, and the pairs of near-equal ones: ``a, b, similarity``.

    ``classes`` has ``cid, h, text``, each text once.  Texts with fewer than
    ``min_words`` words (or ``k``) never pair.  An empty input gives no rows.
    """
    features = materialise(spread(classes).mapInArrow(_features(k, max(k, min_words), *ring(threshold)), "cid long, h binary, keys array<long>, sig binary"), "neardup-features")
    kept = materialise(_chained(features, threshold), "neardup-chains")
    # Only the texts of survivors are moved for the full check.
    once = kept.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "text"), "cid")
    full = (kept.join(once.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
            .join(once.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b"))
    links = materialise(full.mapInArrow(_hamming(k, threshold), "a long, b long, similarity double"), "neardup-links")
    enough = materialise(features.select("cid", "h"), "neardup-enough")
    release(features, kept)
    return enough, links


def _of_class(ids: DataFrame, info: DataFrame) -> DataFrame:
    """``ids`` (``h``) with the row of ``info`` (``h``, ``m`` ids) of their class; no task gets a large class."""
    total = info.agg(F.sum("m")).first()[0] or 0
    hot = F.broadcast(info.filter(F.col("m") * HOT >= total))  # at most HOT rows
    rest = ids.join(hot.select("h"), "h", "left_anti").join(info.filter(F.col("m") * HOT < total), "h")
    return ids.join(hot, "h").unionByName(rest)


def near_duplicates(df: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 0.8, min_words: int = 1) -> DataFrame:
    """Pairs of ids with near-equal texts: ``id_a, id_b, similarity``, ``id_a < id_b``.

    Rows that repeat an id count once for each of its texts.  Ids of the same text
    pair with similarity 1; a class of more than ``MAX_COPIES`` copies is given as a
    star: every member with the smallest id, and links to other texts from the
    smallest ids.  :func:`link_counts` has one form for classes of any size.  Other
    columns of ``df``, whatever their names, are ignored.  Null ids or texts take
    no part.
    """
    rows = _digested(df, id_col, text_col).filter("text is not null")
    classes = _classes(rows)
    enough, links = similar_classes(classes, k, threshold, min_words)
    ids = rows.select("h", "id").distinct()
    sized = ids.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("rep"))
    info = materialise(enough.join(sized, "h"), "neardup-sizes")
    release(classes, enough)
    member = _of_class(ids, info.filter("m > 1"))
    small = member.filter(F.col("m") <= MAX_COPIES).select("cid", "id")
    ends = small.unionByName(info.filter((F.col("m") == 1) | (F.col("m") > MAX_COPIES)).select("cid", F.col("rep").alias("id")))
    across = (links.join(ends.select(F.col("cid").alias("a"), F.col("id").alias("u")), "a")
              .join(ends.select(F.col("cid").alias("b"), F.col("id").alias("v")), "b").select("u", "v", "similarity"))
    within = (small.select("cid", F.col("id").alias("u")).join(small.select("cid", F.col("id").alias("v")), "cid")
              .filter("u < v").select("u", "v", F.lit(1.0).alias("similarity")))
    star = member.filter((F.col("m") > MAX_COPIES) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("u"), F.col("id").alias("v"), F.lit(1.0).alias("similarity"))
    return (across.unionByName(within).unionByName(star)
            .select(F.least("u", "v").alias("id_a"), F.greatest("u", "v").alias("id_b"), "similarity"))


def link_counts(df: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 0.8, min_words: int = 1) -> DataFrame:
    """Every id with the number of ids of near-equal text: ``id, class_id, n_links``.

    ``class_id`` is the smallest id with the same text.  The count is arithmetic on
    class sizes, no pair is expanded: the other copies of the text, where it has
    enough words, and the sizes of the classes linked to it.  Ids without links
    count 0; a null text has no class.  Rows that repeat an id count once, with
    the smallest text digest.
    """
    rows = _digested(df, id_col, text_col)
    ids = materialise(rows.groupBy("id").agg(F.min("h").alias("h")), "neardup-ids")
    classes = _classes(rows.select("h", "text").filter("text is not null"))
    enough, links = similar_classes(classes, k, threshold, min_words)
    sized = ids.filter("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("class_id"))
    ends = links.select(F.col("a").alias("cid"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("cid"), F.col("a").alias("other")))
    # A class without enough words has no number.
    info = materialise(sized.join(enough, "h", "left"), "neardup-sizes")
    release(classes, enough)
    able = info.filter("cid is not null")
    across = ends.join(able.select(F.col("cid").alias("other"), "m"), "other").groupBy("cid").agg(F.sum("m").alias("across"))
    n = F.col("m") - 1 + F.coalesce("across", F.lit(0))
    counted = able.join(across, "cid", "left").select("h", "m", "class_id", n.alias("n_links"))
    known = materialise(counted.unionByName(info.filter("cid is null").select("h", "m", "class_id", F.lit(0).cast("long").alias("n_links"))), "neardup-known")
    none = ids.filter("h is null").select("id", F.lit(None).cast(ids.schema["id"].dataType).alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return _of_class(ids.filter("h is not null"), known).select("id", "class_id", "n_links").unionByName(none)
