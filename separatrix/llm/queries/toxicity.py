"""Toxicity of the documents. Boosting has no SQL; tests use held-out figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from separatrix.llm import toxicity
from separatrix.llm.queries.language_id import fold
from separatrix.llm.registry import query, table


@query("4")
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, labels.filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
