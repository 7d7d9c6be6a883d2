"""Exact duplicates among the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from separatrix.llm import exact_dedup
from separatrix.llm.registry import query, table

SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(text) AS text_sha256
FROM d
WINDOW same AS (PARTITION BY text)
"""


@query("5", SQL)
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, folder, "documents"))
