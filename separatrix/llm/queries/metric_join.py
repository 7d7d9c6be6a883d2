"""Near-duplicate vectors of one label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from separatrix.llm import metric_join
from separatrix.llm.registry import query, table


SQL = """
WITH RECURSIVE v AS MATERIALIZED (
    SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
    FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND len(a.e) = len(b.e)
    WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach(vec_id, other) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(other) AS component_id, min(other) = vec_id AS kept
FROM reach LEFT JOIN counts USING (vec_id) GROUP BY vec_id
"""


@query("8", SQL)
def op8_metric_join(spark: SparkSession, folder: str) -> DataFrame:
    return metric_join.range_links(table(spark, folder, "embeddings"))
