"""Entities and relations from delimited model replies, with a cache and follow-up rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T

# The delimiters of the reply format.
FIELD, END, END_LOWER = "<|#|>", "<|COMPLETE|>", "<|complete|>"
_CUT = r"""^[()"' \t]+|[()"' \t]+$"""

SYSTEM_PROMPT = (
    "List the entities and relations of the passage, one record a line.\n"
    f"entity{FIELD}name{FIELD}type{FIELD}description\n"
    f"relation{FIELD}source{FIELD}target{FIELD}keywords{FIELD}description\n"
    f"Close with {END}."
)
CONTINUE_PROMPT = f"Some records were missed. List only those, in the same format, and close with {END}."


def user_prompt(content: Column) -> Column:
    return F.concat(F.lit("Passage:\n```\n"), content, F.lit("\n```"))


def records(replies: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line_no, kind, fields`` of every line with at least two fields.

    End marks are removed wherever they stand, in capitals or in lower case; lines
    are trimmed, then stripped of brackets, quotes, spaces and tabs at both ends.
    """
    clean = F.replace(F.replace(F.col(text_col), F.lit(END), F.lit("")), F.lit(END_LOWER), F.lit(""))
    lines = replies.select(F.col(id_col).alias("id"), F.posexplode(F.split(clean, "\n")).alias("line_no", "line"))
    # Only lines with a delimiter can be records.
    cut = lines.filter(F.col("line").contains(FIELD)).select("id", "line_no", F.split(F.regexp_replace(T.trim(F.col("line")), _CUT, ""), r"<\|#\|>").alias("fields"))
    kind = F.lower(F.regexp_replace(F.trim(F.get("fields", F.lit(0))), _CUT, ""))
    return cut.filter(F.size("fields") >= 2).select("id", "line_no", kind.alias("kind"), "fields")


def _part(i: int) -> Column:
    return F.regexp_replace(T.trim(F.get("fields", F.lit(i))), "^[\"']+|[\"']+$", "")


def entities(parsed: DataFrame) -> DataFrame:
    """``id, line_no, name, type, description``; the type in lower case."""
    found = parsed.filter(F.col("kind").contains("entity") & (F.size("fields") >= 4))
    return found.select("id", "line_no", _part(1).alias("name"), F.lower(_part(2)).alias("type"), _part(3).alias("description")).filter("name <> ''")


def relations(parsed: DataFrame) -> DataFrame:
    """``id, line_no, src_id, tgt_id, keywords, description, weight``; a weight of 1."""
    found = parsed.filter(~(F.col("kind").contains("entity") & (F.size("fields") >= 4)) & F.col("kind").contains("relation") & (F.size("fields") >= 5))
    out = found.select("id", "line_no", _part(1).alias("src_id"), _part(2).alias("tgt_id"), _part(3).alias("keywords"), _part(4).alias("description"), F.lit(1.0).alias("weight"))
    return out.filter("src_id <> '' and tgt_id <> ''")


def stamp(df: DataFrame, chunk_id: str) -> DataFrame:
    """Adds the chunk a record comes from to its sources."""
    given = F.col("source_ids") if "source_ids" in df.columns else F.array().cast("array<string>")
    return df.withColumn("source_ids", F.array_append(F.coalesce(given, F.array().cast("array<string>")), F.col(chunk_id)))


def split_by_cache(chunks: DataFrame, cache: DataFrame, content: str = "content", version: str = "v1") -> tuple[DataFrame, DataFrame]:
    """Chunks with a stored reply (and it), and chunks without.

    ``cache`` has ``cache_key, raw``; equal contents share an entry.
    """
    known = chunks.withColumn("cache_key", T.cache_key(F.col(content), version))
    return known.join(cache.select("cache_key", "raw"), "cache_key"), known.join(cache.select("cache_key"), "cache_key", "left_anti")


def cache_ratio(hits: DataFrame, misses: DataFrame) -> DataFrame:
    """``n, n_hits, ratio``: how many replies the cache has; a ratio of 0 without any chunk."""
    both = hits.select(F.lit(1).alias("h")).unionByName(misses.select(F.lit(0).alias("h")))
    n, found = F.count(F.lit(1)), F.coalesce(F.sum("h"), F.lit(0))
    return both.agg(n.alias("n"), found.alias("n_hits"), F.coalesce(found / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("ratio"))


def glean(first: DataFrame, again: Callable[[DataFrame, int], DataFrame], rounds: int = 1) -> DataFrame:
    """Adds the entities of follow-up rounds: ``id, name, type, description, round``.

    ``again(active, n)`` returns the parsed entities of round ``n`` for the chunks
    ``active`` (``id``).  A name that the chunk already has is not added again; a
    chunk without a new name is not asked again.
    """
    columns = ["id", "name", "type", "description"]
    held = first.select(*columns, F.lit(0).alias("round"))
    active = held.select("id").distinct()
    for n in range(1, rounds + 1):
        new = (again(active, n).select(*columns).join(active, "id", "left_semi").join(held.select("id", "name"), ["id", "name"], "left_anti")
               .dropDuplicates(["id", "name"]).withColumn("round", F.lit(n)))
        held = held.unionByName(new)
        active = new.select("id").distinct()
    return held


def extract(chunks: DataFrame, complete: Callable[[DataFrame], DataFrame], cache: DataFrame, id_col: str = "chunk_id", content: str = "content",
            version: str = "v1") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relations and new cache rows of all chunks, for a version of the prompt.

    ``complete`` takes ``cache_key, prompt`` and returns ``cache_key, raw``; it sees
    each content that the cache lacks once.
    """
    hits, misses = split_by_cache(chunks, cache, content, version)
    fresh = complete(misses.select("cache_key", user_prompt(F.col(content)).alias("prompt")).dropDuplicates(["cache_key"]))
    replies = hits.select(F.col(id_col).alias("id"), "raw").unionByName(misses.select(F.col(id_col).alias("id"), "cache_key").join(fresh, "cache_key").select("id", "raw"))
    parsed = records(replies, "id", "raw")
    return stamp(entities(parsed), "id"), stamp(relations(parsed), "id"), fresh
