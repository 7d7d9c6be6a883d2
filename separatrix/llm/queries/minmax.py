"""Near-duplicates among the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from separatrix.llm import minmax
from separatrix.llm.registry import query, table


# All pairs of documents that share a shingle; components as what is reachable.
SQL = """
WITH RECURSIVE w AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 1 THEN words
        ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
    SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (shingle)
        WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id) p
    JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, min(other) = doc_id AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


@query("9", SQL)
def op9_minmax_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, folder, "documents"), settings=minmax.Settings(words=2))
