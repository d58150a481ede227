"""Context lines, token budgets and the assembled prompt."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import jsontext
from quern.functions import text as T


@dataclass(frozen=True)
class QueryParam:
    """Settings of a question; values of 0 or less are unset."""

    mode: str = "hybrid"
    top_k: int = 10
    chunk_top_k: int = 5
    max_entity_tokens: int = 4000
    max_relation_tokens: int = 4000
    max_total_tokens: int = 8000

    def with_defaults(self) -> QueryParam:
        base = QueryParam()
        numbers = ("top_k", "chunk_top_k", "max_entity_tokens", "max_relation_tokens", "max_total_tokens")
        return replace(self, mode=self.mode or base.mode, **{n: getattr(self, n) if getattr(self, n) > 0 else getattr(base, n) for n in numbers})


def entity_line(name: Column, kind: Column, description: Column) -> Column:
    return F.concat(F.lit("- "), name, F.lit(" ("), F.coalesce(F.nullif(kind, F.lit("")), F.lit("entity")), F.lit("): "), F.coalesce(description, F.lit("")))


def relation_line(src: Column, tgt: Column, keywords: Column, description: Column) -> Column:
    return F.concat(F.lit("- "), src, F.lit(" -> "), tgt, F.lit(" ["), F.coalesce(F.nullif(keywords, F.lit("")), F.lit("(none)")), F.lit("]: "), F.coalesce(description, F.lit("")))


def pack_rows(df: DataFrame, budget: int | Column, group: list[str], pos: str, tokens: str) -> DataFrame:
    """Rows kept within a token budget, in order: the first always, then up to the first overflow."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    order = Window.partitionBy(*group).orderBy(pos)
    cum = F.sum(tokens).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("_cum", cum).withColumn("_rn", F.row_number().over(order))
    kept = (limit > 0) & ((F.col("_rn") == 1) | ((F.col("_cum") <= limit) & (F.col("_cum") - F.col(tokens) < limit)))
    return marked.filter(kept).drop("_cum", "_rn")


def assemble(question: str, entity_lines: list[str], relation_lines: list[str], chunks: list[tuple[str, str]], param: QueryParam) -> tuple[str, list[str]]:
    """The prompt and the ids of the chunks packed into it.

    Works on the few rows of one question.  Entity and relation sections are cut
    to their budgets, chunks get what is left of the total; the whole is cut to
    the total at the end.
    """
    def cut(s: str, most: int) -> str:
        words = s.split()
        return "" if most <= 0 else s if len(words) <= most else " ".join(words[:most])

    p = param.with_defaults()
    ents, rels = cut("\n".join(entity_lines), p.max_entity_tokens), cut("\n".join(relation_lines), p.max_relation_tokens)
    left = max(p.max_total_tokens - len(ents.split()) - len(rels.split()), 0)
    packed, used = [], 0
    for i, body in chunks:
        n = len(body.split())
        if left <= 0 or packed and (used >= left or used + n > left):
            break
        packed.append((i, body))
        used += n
    text = "\n".join(f"[{i}] {body}" for i, body in packed)
    prompt = f"Answer from the context only.\n\nEntities:\n{ents or '(none)'}\n\nRelations:\n{rels or '(none)'}\n\nPassages:\n{text or '(none)'}\n\nQuestion: {question}"
    return cut(prompt, p.max_total_tokens), [i for i, _ in packed]


KEYWORD_PROMPT = (
    "Name the keywords of the question below as one JSON object with two lists: high_level_keywords for its themes, "
    "low_level_keywords for the names and things in it.\n\nQuestion: {question}\n"
)


def ask_keywords(questions: DataFrame, complete: Callable[[DataFrame], DataFrame], key: str, question: str) -> DataFrame:
    """``key, high, low``: the keywords of each question; where a list cannot be read or is empty, the question itself.

    ``complete`` takes ``key, prompt`` and returns ``key, text``.
    """
    asked = questions.select(key, jsontext.fill(KEYWORD_PROMPT, question=F.col(question)).alias("prompt"))
    back = questions.select(key, F.coalesce(question, F.lit("")).alias("_q")).join(complete(asked).select(key, F.coalesce("text", F.lit("")).alias("_t")), key)
    found = back.select(key, "_q", jsontext.keywords(F.col("_t")).alias("k"))
    return found.select(key, jsontext.or_query(F.col("k.high"), F.col("_q")).alias("high"), jsontext.or_query(F.col("k.low"), F.col("_q")).alias("low"))


def text_content(df: DataFrame, *columns: str) -> Column:
    """The first non-empty of the content columns that the table has."""
    there = [F.col(c) for c in (columns or ("content", "text", "chunk_content")) if c in df.columns]
    return T.first_non_empty(*there)
