"""Quality of the documents. Training has no SQL; tests use brute force and held-out figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from separatrix.llm import quality
from separatrix.llm.queries.language_id import fold
from separatrix.llm.registry import query, table


@query("12")
def op12_factorisation_machine(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = quality.train(docs, labels.filter(~held_out), metadata=("n_chars",))
    return quality.score(docs, model, least=0.3).select("doc_id", held_out.alias("held_out"), "score", "predicted")
