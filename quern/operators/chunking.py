"""Chunkers: table-generating functions over a text column.

All return ``id, chunk_order_index, content, tokens`` with a dense index from 0.
Blank and null texts give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T


def _check(size: int, overlap: int) -> None:
    if not size > overlap > 0:
        raise ValueError("need size > overlap > 0")


def _windows(total: Column, size: int, step: int) -> Column:
    """Numbers of the windows over ``total`` units: the last is the first to reach the end."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((total - size) / step)).cast("int"))


def by_tokens(df: DataFrame, id_col: str, text_col: str, size: int = 1200, overlap: int = 100,
              encode: Callable[[Column], Column] = T.fields, decode: Callable[[Column], Column] = lambda tokens: F.array_join(tokens, " ")) -> DataFrame:
    """Sliding windows of ``size`` tokens, each repeating ``overlap`` of the one before.

    ``encode`` gives the tokens of a text as an array (fields by default, or the
    numbers of a tokenizer), ``decode`` the text of a slice of them.
    """
    _check(size, overlap)
    step = size - overlap
    words = df.select(F.col(id_col).alias("id"), encode(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    # The windows are cut before the rows are multiplied, so no row carries the whole text along.
    parts = F.transform(_windows(F.size("w"), size, step), lambda i: F.slice("w", i * step + 1, F.lit(size)))
    return words.select("id", F.posexplode(parts).alias("chunk_order_index", "part")).select("id", "chunk_order_index", decode(F.col("part")).alias("content"), F.size("part").alias("tokens"))


def _dense(df: DataFrame, place: str) -> DataFrame:
    """Splits the array ``parts`` of non-blank texts into rows with a dense index."""
    return df.select("id", F.posexplode(place).alias("chunk_order_index", "content"))


def by_characters(df: DataFrame, id_col: str, text_col: str, size: int = 1200, overlap: int = 100, per_token: int = 4) -> DataFrame:
    """Windows of ``size * per_token`` characters; trimmed, blank ones skipped, tokens counted again."""
    _check(size, overlap)
    width, step = size * per_token, (size - overlap) * per_token
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter(~T.is_blank(F.col("t")))
    parts = F.transform(_windows(F.length("t"), width, step), lambda i: T.trim(F.substring(F.col("t"), i * step + 1, F.lit(width))))
    out = _dense(base.select("id", F.filter(parts, lambda p: p != "").alias("parts")), "parts")
    return out.withColumn("tokens", T.token_count(F.col("content")))


def by_paragraphs(df: DataFrame, id_col: str, text_col: str, most: int | None = 1200) -> DataFrame:
    """Paragraphs between blank lines, trimmed; longer ones cut every ``most`` characters.

    ``tokens`` is the number of characters when paragraphs are cut, the number of
    fields when they are not (``most=None``).
    """
    paragraphs = F.filter(F.transform(F.split(F.col(text_col), "\n\n"), T.trim), lambda p: p != "")
    base = df.select(F.col(id_col).alias("id"), paragraphs.alias("p"))
    if most is None:
        return _dense(base, "p").withColumn("tokens", T.token_count(F.col("content")))
    pieces = F.flatten(F.transform("p", lambda p: F.transform(
        F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))))
    return _dense(base.select("id", pieces.alias("p")), "p").withColumn("tokens", F.length("content"))


def pack_greedily(items: Column, budget: int) -> Column:
    """Packs an ordered array of texts into windows of at most ``budget`` fields.

    A text that does not fit closes the window and opens the next, but joins a
    window of a single text even beyond the budget, so every window but the last
    holds two or more.  A fold, since each step depends on the resets before it.
    """
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("tok"))

    def step(s: Column, x: Column) -> Column:
        n = T.token_count(x)
        fits = (s["tok"] + n <= budget) | (F.size(s["open"]) == 0)
        forced = F.size(s["open"]) == 1
        closed = F.array_append(s["done"], F.array_append(s["open"], x))
        return (F.when(fits, F.struct(s["done"].alias("done"), F.array_append(s["open"], x).alias("open"), (s["tok"] + n).alias("tok")))
                .when(forced, F.struct(closed.alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("tok")))
                .otherwise(F.struct(F.array_append(s["done"], s["open"]).alias("done"), F.array(x).alias("open"), n.alias("tok"))))

    return F.aggregate(items, start, step, lambda s: F.when(F.size(s["open"]) > 0, F.array_append(s["done"], s["open"])).otherwise(s["done"]))
