"""Oversized texts cut at natural boundaries by content-defined chunking.

A token is a whitespace-separated field in the Unicode sense.  A rolling hash
over ``WINDOW`` tokens marks, within the allowed sizes after the last cut, the
position of its smallest value: a landmark that depends on the words around it
alone.  The cut snaps from the landmark to the nearest natural boundary (the
distance counts half to a paragraph end and three quarters to a line end).  Where no
boundary lies between the least and the largest size, the cut goes to the last one
below the least size, if the piece still holds more than it repeats: a natural
boundary comes before the least size.  Only where there is none at all does it stay
at the landmark.  Since landmarks move only
with the words around them, an edit alters neighbouring pieces only.

Each piece after the first repeats the last ``overlap`` tokens of the piece before,
and counts them.  Pieces are exact substrings, so the text without the overlaps
can be put together again.

Defined results: a text within the limit is one piece, unchanged; null and blank
texts are one piece of 0 tokens; a text without spaces is one token, however
long, and never cut.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space in the Unicode sense (property White_Space), for Java, Python and RE2 alike.
SPACE = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MAX_TOKENS, OVERLAP, MIN_TOKENS, WINDOW = 240, 24, 100, 8
#: Chunks of a document that are numbered together.
NUMBER_BLOCK = 1000


def token_count(text: Column) -> Column:
    """Number of whitespace-separated fields; 0 for null and blank texts."""
    return F.coalesce(F.size(F.filter(F.split(text, f"[{SPACE}]+"), lambda x: x != "")), F.lit(0))


def landmarks(tokens: list[str], window: int = WINDOW) -> np.ndarray:
    """Rolling hash of the tokens around each position (before it, in the window)."""
    h = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in tokens), np.uint64, len(tokens))
    out = np.zeros(len(tokens) + 1, np.uint64)
    with np.errstate(over="ignore"):
        weight = np.uint64(0x9E3779B97F4A7C15)
        for i in range(window):
            # The token i places before the cut, weighted by its place.
            out[i + 1 :] = out[i + 1 :] * np.uint64(31) + h[: len(tokens) - i] * weight
            weight = weight * np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    with np.errstate(over="ignore"):
        out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(32))


def cuts(text: str, limit: int = MAX_TOKENS, overlap: int = OVERLAP, least: int = MIN_TOKENS) -> tuple[list[tuple[int, int]], list[int]]:
    """Token spans in the text and the token positions at which it is cut."""
    spans = [m.span() for m in re.finditer(f"[^{SPACE}]+", text)]
    n = len(spans)
    if n <= limit:
        return spans, []
    room = limit - overlap
    least = max(1, min(least, room))
    hashes = landmarks([text[a:b] for a, b in spans])
    # Cost of moving a cut by one token to a boundary after each token; 0 means no boundary.
    pull = np.zeros(n + 1)
    for i in range(1, n):
        gap = text[spans[i - 1][1] : spans[i][0]]
        if re.search(r"(\r\n|\r|\n)[ \t]*(\r\n|\r|\n)", gap):
            pull[i] = 0.5
        elif "\n" in gap or "\r" in gap:
            pull[i] = 0.75
        elif re.search(r"[.!?。！？…;；][\"'”’)\]」』]*$", text[spans[i - 1][0] : spans[i - 1][1]]):
            pull[i] = 1.0
    at, out = 0, []
    while n - at > (limit if not out else room):
        low, high = at + least, at + room
        mark = low + int(np.argmin(hashes[low : high + 1]))
        natural = np.flatnonzero(pull[low : high + 1]) + low
        if not len(natural):
            # None in reach: the last one before, if it leaves a piece longer than its overlap.
            early = np.flatnonzero(pull[at + overlap + 1 : low]) + at + overlap + 1
            at = int(early[-1]) if len(early) else mark
        else:
            at = int(natural[np.argmin(np.abs(natural - mark) * pull[natural])])
        out.append(at)
    return spans, out


def split_text(text: str, limit: int = MAX_TOKENS, overlap: int = OVERLAP, least: int = MIN_TOKENS) -> list[tuple[str, int]]:
    """The pieces of a text with their numbers of tokens."""
    spans, at = cuts(text, limit, overlap, least)
    if not at:
        return [(text, len(spans))]
    out, starts, ends = [], [0, *at], [*at, len(spans)]
    for i, (a, b) in enumerate(zip(starts, ends)):
        first = a - overlap if i else 0
        begin = spans[first][0] if i else 0
        end = spans[b - 1][1] if b < len(spans) else len(text)
        out.append((text[begin:end], b - first))
    return out


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = MAX_TOKENS, overlap: int = OVERLAP, least: int = MIN_TOKENS) -> DataFrame:
    """``id, piece_no, n_pieces, content, n_tokens`` of every row of ``df``.

    Only texts above the limit leave the JVM.  Other columns are not kept.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("content"))
    # Fewer than 2 * limit bytes hold at most limit fields, so most texts are not even split.
    tokens = F.when(F.octet_length("content") >= 2 * limit, token_count(F.col("content")))
    counted = base.withColumn("n_tokens", tokens)
    fits = counted.filter(F.col("n_tokens").isNull() | (F.col("n_tokens") <= limit)).select(
        "id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), "content", token_count(F.col("content")).alias("n_tokens"))

    def run(batches):
        for batch in batches:
            ids, no, of, texts, sizes = [], [], [], [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("content").to_pylist()):
                pieces = split_text(text, limit, overlap, least)
                ids += [i] * len(pieces)
                no += range(len(pieces))
                of += [len(pieces)] * len(pieces)
                texts += [p for p, _ in pieces]
                sizes += [n for _, n in pieces]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("id").type), pa.array(no, pa.int32()), pa.array(of, pa.int32()),
                                              pa.array(texts, pa.string()), pa.array(sizes, pa.int32())], names=["id", "piece_no", "n_pieces", "content", "n_tokens"])

    kind = dict(base.dtypes)["id"]
    large = counted.filter(F.col("n_tokens") > limit).select("id", "content").mapInArrow(
        run, f"id {kind}, piece_no int, n_pieces int, content string, n_tokens int")
    return fits.unionByName(large)


def renumber(pieces: DataFrame) -> DataFrame:
    """Adds ``chunk_order_index``: the place of a piece among all pieces of its document.

    ``pieces`` has ``doc_id``, ``place`` (the old place of its chunk), ``id`` and
    ``piece_no``.  A document is numbered in blocks of ``NUMBER_BLOCK`` old places;
    the counts of earlier blocks are added, so a document of a third of all rows
    is not one task.
    """
    blocked = pieces.withColumn("_block", F.floor(F.col("place") / NUMBER_BLOCK))
    counts = blocked.groupBy("doc_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("doc_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("doc_id", "_block").orderBy("place", "id", "piece_no")
    return (blocked.withColumn("_r", F.row_number().over(within)).join(offsets, ["doc_id", "_block"])
            .withColumn("chunk_order_index", (F.col("_before") + F.col("_r") - 1).cast("int")).drop("_block", "_r", "_before"))
