"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.bpe import SPLIT_PATTERN, load

#: Place of the rank file; a parameter of every operator that counts tokens.
RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def token_sizes(df: DataFrame, keys: list[str], text_col: str = "text", rank_file: str = RANK_FILE, pattern: str = SPLIT_PATTERN) -> DataFrame:
    """``keys`` and ``n_tokens`` of every row whose text has at least one token.

    The whole text is encoded.  Null and empty texts have no tokens and no row.
    """
    def run(batches):
        encoding = None
        for batch in batches:
            if not batch.num_rows:
                continue
            encoding = encoding or load(rank_file, pattern)
            sizes = [len(encoding.encode_ordinary(t)) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(sizes, pa.int64())], names=[*keys, "n_tokens"])

    kinds = dict(df.dtypes)
    texts = df.select(*keys, F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull() & (F.col("_text") != ""))
    return texts.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n_tokens long")
