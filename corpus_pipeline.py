"""A training-data pipeline over the documents, and the queries of its operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's documents. A decision names a row by its doc_id and its
text, so a doc_id may come with several texts. Rows without a doc_id cannot be named and
stay; rows that repeat are kept or dropped alike.
"""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession, functions as F

from separatrix.llm import exact_dedup, language_id, minmax, queries, secret_scan
from separatrix.llm.queries.packing import packed
from separatrix.llm.registry import QUERIES, query, table
from separatrix.storage import materialize

for module in pkgutil.iter_modules(queries.__path__):
    importlib.import_module(f"{queries.__name__}.{module.name}")

__all__ = ["ORACLE_SQL", "QUERIES", "STAGES", "run"]


def _with_digest(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__digest", F.sha2(F.coalesce("text", F.lit("")), 256))


def _without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """``docs`` but for the rows that are not kept (by ``doc_id`` and ``__digest``). Spark picks the join by their number."""
    gone = judged.filter("not kept").select("doc_id", "__digest").distinct()
    return _with_digest(docs).join(gone, ["doc_id", "__digest"], "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, or a mixture of several; the model learns from all that have a label.

    Only what the operator calls undetermined goes. The share of the first language says
    nothing against a text: parallel texts, and languages without a label, spread over several.
    """
    judged = language_id.predict(docs, language_id.train(docs))
    return judged.filter(F.col("lang_pred") != language_id.UNDETERMINED).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return _without(docs, exact_dedup.deduplicate(docs).withColumnRenamed("text_sha256", "__digest"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, 0.8 or more."""
    return _without(docs, minmax.near_duplicates(_with_digest(docs), carried=("__digest",)))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind."""
    return secret_scan.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packed(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("secret_scan", secrets),
    ("packing", packing),
]

# Language models, signatures and packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


@query("pipeline", ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder)
