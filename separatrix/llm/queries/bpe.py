"""Documents as token ids and back. Merges have no SQL over the tables; tests use the tokenizer library."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from separatrix.llm import bpe
from separatrix.llm.registry import query, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query("10")
def op10_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    ranks = bpe.read_ranks(VOCABULARY)
    ids = bpe.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    counted = ids.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256")
    )
    return bpe.decode(counted, ranks).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
