"""Secrets in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from separatrix.llm import secret_scan
from separatrix.llm.registry import query, table

BASE = ("assign", "access", "hex")


def _kind(rule: secret_scan.Rule, place: int) -> str:
    """SQL for the spans of one kind: lengths of gap and match add up to positions."""
    pattern = "(?s)(.*?)(" + rule.pattern + ")"
    pattern = pattern.replace("'", "''")
    value = 3 if rule.has_value else 2
    groups = [f"regexp_extract_all(text, '{pattern}', {g}) AS g{n}" for n, g in enumerate((0, 1, value))]
    return f"""
    SELECT doc_id, '{rule.kind}' AS kind, {place} AS place,
           sum(whole) OVER w - whole + gap AS s, sum(whole) OVER w AS e, value
    FROM (SELECT doc_id, unnest(range(len(g0))) AS i, length(unnest(g0)) AS whole,
                 length(unnest(g1)) AS gap, length(unnest(g2)) AS value
          FROM (SELECT doc_id, {", ".join(groups)} FROM d))
    WINDOW w AS (PARTITION BY doc_id ORDER BY i)
    QUALIFY value >= {rule.least}"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_kind(r, i) for i, r in enumerate(secret_scan.RULES))}),
g AS (
    SELECT doc_id,
           count(*) FILTER (kind = 'assign') AS n_assign,
           count(*) FILTER (kind = 'access') AS n_access,
           count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, place) FILTER (place < 3) AS base,
           string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, place) AS spans
    FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


@query("7", SQL)
def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = F.col("found")
    # In two deliveries: the second one scans only what the first did not hold.
    return secret_scan.scan_documents(table(spark, folder, "documents"), deliveries=2).select(
        "doc_id",
        *(secret_scan.count_of(found, k).alias(f"n_{k}") for k in BASE),
        F.sha2(secret_scan.joined(secret_scan.any_of(found, BASE)), 256).alias("base_sha256"),
        secret_scan.joined(found).alias("spans"),
    )
