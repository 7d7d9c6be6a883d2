"""Documents packed into sequences. Packing has no SQL; tests check bounds, gaps and round trips."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from separatrix.llm import packing
from separatrix.llm.registry import query, table


def vocabulary() -> bytes:
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        return file.read()


def packed(docs: DataFrame) -> DataFrame:
    """Pieces with their places and compressed ids; ``packing.sequences`` makes the sequences of them."""
    cut_up = packing.pieces(docs, vocabulary(), public_tokenizers.PATTERN, encode_special_tokens=False, compress=True)
    return packing.pack(cut_up)


@query("2")
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))
