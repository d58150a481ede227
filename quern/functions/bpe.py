"""Byte-pair tokens of a public vocabulary as Columns.

``rank_file`` is a file of base64 tokens and their ranks, ``pattern`` the regular
expression that splits a text before the merges.  Texts are encoded in Arrow batches
with one encoder a partition.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the usual split pattern of byte-level vocabularies of this kind.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load(rank_file: str, pattern: str = SPLIT_PATTERN):
    """The encoder of a rank file; it must be readable on every executor."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoder(rank_file: str, pattern: str = SPLIT_PATTERN) -> Callable[[Column], Column]:
    """Texts to arrays of token numbers; null for null, empty for empty."""
    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = load(rank_file, pattern)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else encoding.encode_ordinary(t))

    return encode


def decoder(rank_file: str, pattern: str = SPLIT_PATTERN) -> Callable[[Column], Column]:
    """Arrays of token numbers to texts; what is left of a cut character becomes a replacement mark."""
    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = load(rank_file, pattern)
        for tokens in batches:
            yield tokens.map(lambda t: None if t is None else encoding.decode([int(x) for x in t]))

    return decode
