"""Text primitives as Columns.  White space is the Unicode property White_Space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space for Java regular expressions, written out so that SQL engines can use the same class.
SPACE = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def fields(text: Column) -> Column:
    """Whitespace-separated fields; empty for blank, null for null."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda x: x != "")


def token_count(text: Column) -> Column:
    """Number of fields; 0 for null and blank texts."""
    return F.coalesce(F.size(fields(text)), F.lit(0))


def is_blank(text: Column) -> Column:
    return token_count(text) == 0


def trim(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def truncate_tokens(text: Column, limit: int) -> Column:
    """The text if it has at most ``limit`` fields, else the first ones joined by spaces; '' for a limit of 0 or less."""
    if limit <= 0:
        return F.lit("")
    words = fields(text)
    return F.when(F.size(words) <= limit, text).otherwise(F.array_join(F.slice(words, 1, limit), " "))


def content_id(text: Column) -> Column:
    """Content-addressed document id: md5 of the bytes."""
    return F.md5(text)


def cache_key(content: Column, version: str = "v1") -> Column:
    """Key of a cached extraction: sha-256 of the content and the prompt version."""
    return F.concat(F.lit("extract:"), F.sha2(F.concat(content, F.lit("|" + version)), 256))


def summary(text: Column, length: int = 100) -> Column:
    """The first characters, never half of one."""
    return F.substring(text, 1, length)


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit("::chunk-"), index.cast("string"))


def first_non_empty(*columns: Column) -> Column:
    """The first column that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def one_line(text: Column, length: int) -> Column:
    """Display form: line ends as spaces, cut to a length."""
    return F.substring(F.regexp_replace(text, r"[\r\n]+", " "), 1, length)
