"""Token counts: batch encoding inside Arrow functions that return lengths only.

Every whole text is counted exactly as the tokenizer file's library counts it (see `tokens.py`:
long texts are split at safe boundaries, batches are balanced by bytes). No shuffle; a worker's
memory is bounded by the batch and by the remembered pieces.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows count alike; other
columns pass through, and a column of the name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import encoder, tokenizer_path

LIMIT = 512


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a text column (null: 0)."""
    path = path or tokenizer_path()

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path, "count")
        for texts in batches:
            yield pa.array(list(enc.values([t or "" for t in texts.to_pylist()])), pa.int64())

    return F.arrow_udf(count, "long")(text)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit to every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("n_bytes", F.octet_length(text).cast("long")).withColumn("n_tokens", token_count(text, path))
    return df.withColumn("over_limit", F.col("n_tokens") > limit)
