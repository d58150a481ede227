"""Tolerant reading of JSON in model replies, and writing of JSON lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEYWORDS = "high_level_keywords array<string>, low_level_keywords array<string>, highLevelKeywords array<string>, lowLevelKeywords array<string>"


def strip_fences(text: Column) -> Column:
    """Without an opening fence line and a closing fence."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(trimmed.startswith("```"), F.regexp_replace(F.regexp_replace(trimmed, r"^```[^\n]*\n?", ""), r"\s*```$", "")).otherwise(trimmed)


def first_object(text: Column) -> Column:
    """The first balanced ``{...}``, braces in strings counted like others; '' if there is none.

    A fold over the brace positions: depth per character, cut where it returns to 0.
    """
    start = F.instr(text, "{")
    chars = F.split(F.substr(text, F.greatest(start, F.lit(1))), "")
    state = F.aggregate(chars, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("end")), lambda s, c: F.when(s["end"], s).otherwise(
        F.struct((s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"), (s["n"] + 1).alias("n"), ((c == "}") & (s["depth"] == 1)).alias("end"))))
    return F.when((start > 0) & state["end"], F.substr(text, start, state["n"])).otherwise(F.lit(""))


def clean_list(items: Column) -> Column:
    """Trimmed, without empty items, order and repeats kept; empty for null."""
    return F.coalesce(F.filter(F.transform(items, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), F.array().cast("array<string>"))


def keywords(reply: Column) -> Column:
    """``high, low``: the two keyword lists of a reply; empty where it cannot be read."""
    parsed = F.from_json(first_object(strip_fences(reply)), _KEYWORDS)

    def pick(a: str, b: str) -> Column:
        return F.when(F.size(F.coalesce(parsed[a], F.array().cast("array<string>"))) > 0, clean_list(parsed[a])).otherwise(clean_list(parsed[b]))

    return F.struct(pick("high_level_keywords", "highLevelKeywords").alias("high"), pick("low_level_keywords", "lowLevelKeywords").alias("low"))


def or_query(items: Column, query: Column) -> Column:
    """The keywords, or the query itself where there are none."""
    return F.when(F.size(items) > 0, items).otherwise(F.array(query))


def json_lines(texts: Column, field: str = "Description") -> Column:
    """One object a line."""
    return F.array_join(F.transform(texts, lambda t: F.to_json(F.struct(t.alias(field)))), "\n")


def quote_list(texts: Column) -> Column:
    return F.to_json(texts)


def fill(template: str, **values: Column) -> Column:
    """A template with its ``{name}`` places filled in one pass."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])
