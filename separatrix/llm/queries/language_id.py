"""Languages of the documents. EM has no SQL; tests use brute force and held-out accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from separatrix.llm import language_id
from separatrix.llm.registry import query, table


def fold(doc_id: Column, folds: int) -> Column:
    """The rest of the id's checksum; -1 without an id, which is in no fold, so such rows are learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def model_of(docs: DataFrame) -> language_id.Model:
    """Trained on the documents outside the held-out fold."""
    return language_id.train(docs.filter(fold(F.col("doc_id"), 4) != 2))


@query("1")
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    predicted = language_id.predict(docs.select("doc_id", "text"), model_of(docs))
    return predicted.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "languages")
