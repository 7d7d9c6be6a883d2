"""Periodic runs of words in the documents, some of which are made periodic first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from separatrix.llm import periodic_runs
from separatrix.llm.registry import query, table

WORD = r"[^\x20\x09-\x0D]+"

# Equal grams of 16 words are on one diagonal wherever a run is: its period is at most 8 or
# twice the period is 16 and more.
SQL = r"""
WITH t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, b::BIGINT)) AS crc),
raw AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
               lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
    FROM documents, t),
sized AS (SELECT *, len(words) AS n, h // 10 AS g FROM raw),
placed AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM sized),
planned AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
d AS MATERIALIZED (
    SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN list_transform(range(n), lambda i: words[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1]) ELSE words END AS words
    FROM planned),
grams AS MATERIALIZED (
    SELECT doc_id, i, md5_number(array_to_string(words[i + 1:i + 16], ' ')) AS gram
    FROM (SELECT doc_id, words, unnest(range(n - 15)) AS i FROM d WHERE n >= 16)),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS s, max(i) + 16 + q AS e FROM islands GROUP BY doc_id, q, island),
runs AS MATERIALIZED (
    SELECT doc_id, s, e - s AS l, min(q) AS q FROM stretches WHERE e - s >= greatest(24, 3 * q) GROUP BY doc_id, s, e),
listed AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM runs GROUP BY doc_id),
best AS (
    SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND
        (o.l * r.q > r.l * o.q OR o.l * r.q = r.l * o.q AND (o.s < r.s OR o.s = r.s AND o.q < r.q)))),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (
    SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS words
    FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(words) AS word FROM d) w ANTI JOIN dropped USING (doc_id, i) GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period,
       1000 * best.l // best.q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.words, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; every tenth text, by digest of its id, repeats a part of itself to its end."""
    digest = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.when(digest % 10 == 0, F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)))
    rows = docs.select("doc_id", "text", F.floor(digest / 10).alias("g"), chosen.alias("words")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    part = F.slice("words", F.col("a") + 1, F.col("p"))
    often = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    anew = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), F.flatten(F.array_repeat(part, often))), F.lit(1), F.col("n"))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(anew, " ")).otherwise(F.col("text")).alias("text"))


@query("11", SQL)
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_periods(table(spark, folder, "documents")))
    # Runs are in order of start and period, so of equal exponents the first one stays.
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", nothing, lambda best, r: F.when(better(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
