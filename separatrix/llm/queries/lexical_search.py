"""The documents that rank highest for each item of the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from separatrix.llm import lexical_search
from separatrix.llm.registry import query, table
from separatrix.storage import materialize

SQL = r"""
WITH lower_items AS (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark),
lower_docs AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
q AS MATERIALIZED (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lower_items)
    GROUP BY item_id, term),
p AS MATERIALIZED (
    SELECT doc_id, term, count(*) AS tf FROM (
        SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lower_docs)
    GROUP BY doc_id, term),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
s AS (SELECT count(*) AS size, sum(n)::BIGINT AS total FROM n),
m AS (SELECT doc_id, 100 - 25 + (25 * n * size) // total AS m FROM n, s),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * size + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, size),
scores AS (
    SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scores WHERE score > 0)
SELECT item_id, r::INTEGER AS rank, doc_id, score FROM ranked WHERE r <= 20
"""


@query("13", SQL)
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    index = materialize(lexical_search.build(table(spark, folder, "documents")), "lexical-index")
    found = lexical_search.search(index, table(spark, folder, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")
