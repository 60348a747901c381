"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, utf8_size
from .encoders import counter, default_vocabulary, is_byte_level, prove_whole


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (more than ``limit`` tokens) to each row.

    The count is that of the vocabulary's library over the whole text, without added
    tokens. NULL and empty texts have 0 bytes and 0 tokens. Rows, ties and repeats are
    kept one to one; columns named like an output are replaced, others pass through.
    One scan, no shuffle; a worker holds one Arrow batch, the proven tokens and a
    bounded memo. A text may be of any length, also one run of white space or letters.
    """
    # as many strings as the vocabulary has at most
    whole = df.sparkSession.sparkContext.broadcast(prove_whole(vocabulary) if is_byte_level(vocabulary) else None)

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(vocabulary, whole.value).count
        for batch in batches:
            yield pd.Series([count(x) for x in batch], dtype="int64")

    bounded_batches(df.sparkSession)
    return df.withColumns({"n_bytes": utf8_size(F.col(text)), "n_tokens": tokens(F.col(text))}).withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, default_vocabulary()).select("doc_id", "n_bytes", "n_tokens", "over_limit")
