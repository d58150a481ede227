"""Deterministic hash embedders as Columns: no model, no network, same vector for same text."""

from __future__ import annotations

import hashlib
import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V


def _hex_value(digest: Column, offset: Column | int, digits: int) -> Column:
    """The number written by ``digits`` hex digits of a digest from an offset (from 0)."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    return F.conv(F.substring(digest, at + 1, F.lit(digits)), 16, 10).cast("double")


def tiled(text: Column, dim: int) -> Column:
    """Bytes of the sha-256 of the text repeated to ``dim``, centred and normalised."""
    raw = V.let(F.sha2(text, 256), lambda digest: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (_hex_value(digest, (i % 32) * 2, 2) - 127.5) / 127.5))
    return V.normalise(raw)


def counter(text: Column, dim: int) -> Column:
    """As :func:`tiled`, but block ``r`` of 32 components hashes the text with a four-byte counter."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit((dim - 1) // 32)),
                         lambda r: F.sha2(F.concat(text.cast("binary"), F.unhex(F.lpad(F.hex(r), 8, "0"))), 256))
    raw = V.let(F.array_join(blocks, ""), lambda digest: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: _hex_value(digest, i * 2, 2) / 127.5 - 1))
    return V.normalise(raw)


def words(text: Column, dim: int) -> Column:
    """Bag of words: every lower-case field adds ``dim`` components from its sha-256; no fields give zeros.

    Component ``i`` reads four bytes at offset ``(4 i) mod 28``, so components
    seven apart repeat.
    """
    digests = F.transform(T.fields(F.lower(text)), lambda w: F.sha2(w, 256))

    def components(ds: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(
            ds, F.lit(0.0), lambda s, d: s + _hex_value(d, ((i * 4) % 28) * 2, 8) / 4294967295.0 * 2 - 1))

    return V.normalise(V.let(digests, components))


def counter_vector(text: str, dim: int) -> list[float]:
    """:func:`counter` for one query text on the driver."""
    raw: list[float] = []
    r = 0
    while len(raw) < dim:
        raw += [b / 127.5 - 1 for b in hashlib.sha256(text.encode() + struct.pack(">I", r)).digest()]
        r += 1
    raw = raw[:dim]
    n = math.sqrt(sum(x * x for x in raw))
    return [x / n for x in raw] if n else raw


def entity_text(name: Column, description: Column) -> Column:
    """What is embedded for an entity."""
    return F.concat_ws(" ", name, description)


def relation_text(keywords: Column, description: Column) -> Column:
    return F.concat_ws(" ", keywords, description)
