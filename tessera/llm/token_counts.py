"""Token counts by a map-side two-tier lookup: a broadcast table of frequent pre-token lengths, worker caches for the rest.

No pre-token is ever shuffled; a text is read once where it lies. The table has one entry for each vocabulary entry
that is a whole pre-token, so the vocabulary bounds what is broadcast (under 2 MB).

Defined results: null text counts as empty with 0 bytes and tokens; repeated rows each get a row; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.pretokens import frequent, pieces


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text. tokenizer_path: a tokenizers .json of byte-level BPE."""
    small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(frequent(tokenizer_path, False))

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(pieces(tokenizer_path, False, table.value).encode(texts.tolist()), dtype="int64")

    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    counted = docs.select(docs[id_col], F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
