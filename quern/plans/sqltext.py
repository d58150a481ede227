"""Pieces of SQL that several catalogue entries share."""

from __future__ import annotations

#: White space class of :data:`quern.functions.text.SPACE`, as the SQL engine writes it.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def fields(column: str) -> str:
    return f"regexp_extract_all({column}, '[^{SPACE}]+')"


def trimmed(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')"


def deliveries(name: str, key: str, columns: str, order: str) -> str:
    """One row per key: the latest delivery."""
    return f"(SELECT {key}, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {name} WHERE {key} IS NOT NULL) WHERE rn = 1)"


STATUS = deliveries("doc_status", "doc_id", "status, updated_at, chunks_list, content_length, error_msg", "updated_at DESC, created_at DESC")
CHUNKS = deliveries("chunks", "chunk_id", "doc_id, content, tokens, chunk_order_index, created_at", "created_at DESC")
VECTORS = deliveries("vector_index", "id", "namespace, vector, norm, metadata", "ingested_at DESC")
