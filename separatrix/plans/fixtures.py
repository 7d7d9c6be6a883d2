"""Stand-ins for reviews, loans, flowers and sample streams, as DataFrames and as SQL.

The SQL side is a set of named common table expressions; ``with_sql`` puts the ones
a query needs in front of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from separatrix.functions.text import PUNCTUATION, remove_punctuation, vocabulary, with_word_vector
from separatrix.operators.sampling import balance_classes, random_split
from separatrix.operators.tables import drop_neutral, rating_sentiment, safe_label
from separatrix.sources.readers import load_table, xor_label
from separatrix.storage import materialize, spread

# Fixed value: the length of the word list.
WORDS = 193
SPLIT_SEED = 2
BALANCE_SEED = 1
TRAIN_SHARE = 0.8

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return load_table(spark, f"{folder}/{name}.parquet", SCHEMAS[name])


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, text)``."""
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


# --- Spark side -----------------------------------------------------------------


def rated(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, rating)`` of every label."""
    judged = table(spark, folder, "labels")
    odd = (F.col("doc_id") % 2).cast("int")
    rating = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 1), 3)
        .when(F.col("quality") == 1, 4 + odd)
        .otherwise(1 + odd)
    )
    return judged.select("doc_id", rating.alias("rating"))


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, rating)`` of the labelled documents; the join reads keys, not texts."""
    known = table(spark, folder, "documents").select("doc_id")
    return rated(spark, folder).join(known, "doc_id")


def opinions(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, rating, sentiment)`` of the reviews that are not neutral."""
    return drop_neutral(ratings(spark, folder)).withColumn("sentiment", rating_sentiment("rating"))


def balanced_opinions(spark: SparkSession, folder: str) -> DataFrame:
    return balance_classes(opinions(spark, folder), "doc_id", "sentiment", BALANCE_SEED)


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, text, rating)``."""
    texts = documents(spark, folder)
    return texts.join(rated(spark, folder), "doc_id")


def review_words(spark: SparkSession, folder: str, k: int = WORDS) -> list[str]:
    """The ``k`` most frequent words of the cleaned reviews."""
    return vocabulary(reviews(spark, folder), remove_punctuation("text"), k)


def review_matrix(spark: SparkSession, folder: str, words: list[str]) -> DataFrame:
    """``(doc_id, features, rating, sentiment, split)`` of the balanced reviews.

    Texts become count vectors before the join, so the join moves vectors only.
    The matrix is stored: training and scoring read it, and the texts once.
    """
    texts = documents(spark, folder).select("doc_id", remove_punctuation("text").alias("clean"))
    vectors = with_word_vector(texts, "clean", words).select("doc_id", "features")
    tagged = random_split(balanced_opinions(spark, folder), "doc_id", TRAIN_SHARE, SPLIT_SEED)
    return materialize(vectors.join(tagged, "doc_id"), "review-matrix")


def loans(spark: SparkSession, folder: str) -> DataFrame:
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    flagged = joined.select(
        F.col("o_orderkey").alias("loan_id"),
        F.col("o_orderpriority").alias("purpose"),
        F.col("c_mktsegment").alias("home_ownership"),
        F.col("c_nationkey").alias("grade"),
        F.col("o_totalprice").alias("amount"),
        F.col("c_acctbal").alias("balance"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("bad_loans"),
    )
    return flagged.withColumn("safe_loans", safe_label("bad_loans"))


def balanced_loans(spark: SparkSession, folder: str) -> DataFrame:
    """Loans with equal classes and a train/test tag."""
    even = balance_classes(loans(spark, folder), "loan_id", "safe_loans", BALANCE_SEED)
    # Another seed than that of balancing, which would leave one class in the test rows.
    return random_split(even, "loan_id", TRAIN_SHARE, SPLIT_SEED)


def flowers(spark: SparkSession, folder: str) -> DataFrame:
    """Two measures, a three-way species, and -1 for the first label against the rest."""
    vectors = table(spark, folder, "embeddings")
    return vectors.select(
        F.col("vec_id").alias("flower_id"),
        F.get("embedding", F.lit(0)).cast("double").alias("x0"),
        F.get("embedding", F.lit(2)).cast("double").alias("x1"),
        F.when(F.col("label") == 0, -1).otherwise(1).alias("y"),
        (F.col("label") % 3).alias("species"),
    )


def quadrants(spark: SparkSession, folder: str) -> DataFrame:
    """Points of the plane with their XOR label."""
    vectors = table(spark, folder, "embeddings")
    points = vectors.select(
        F.col("vec_id").alias("point_id"),
        F.get("embedding", F.lit(0)).cast("double").alias("x0"),
        F.get("embedding", F.lit(1)).cast("double").alias("x1"),
    )
    return points.withColumn("label", xor_label(F.col("x0"), F.col("x1")))


def as_samples(events: DataFrame) -> DataFrame:
    """Events as training samples in time order; works on streams too."""
    return events.select(
        "event_id",
        "ts",
        "user_id",
        (F.col("value") / F.lit(100.0)).alias("x"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("y"),
    )


def samples(spark: SparkSession, folder: str) -> DataFrame:
    return as_samples(table(spark, folder, "events"))


# --- SQL side -------------------------------------------------------------------

_QUOTED = PUNCTUATION.replace("'", "''")
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def clean_sql(text: str) -> str:
    return f"translate({text}, '{_QUOTED}', '')"


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_SPACE}'), lambda t: t <> '')"


def uniform_sql(key: str, seed) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {key}::VARCHAR, '{seed}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def balance_sql(source: str, key: str, label: str, seed) -> str:
    return f"""
    SELECT s.* FROM {source} s, (
        SELECT arg_max({label}, n * 10 + {label}) AS larger, min(n)::DOUBLE / max(n) AS ratio
        FROM (SELECT {label}, count(*) AS n FROM {source} GROUP BY {label}) t
    ) c
    WHERE s.{label} <> c.larger OR {uniform_sql(f's.{key}', seed)} < c.ratio"""


def split_sql(key: str, fraction: float, seed) -> str:
    return f"CASE WHEN {uniform_sql(key, seed)} < {fraction}::DOUBLE THEN 'train' ELSE 'test' END"


CTES = {
    "reviews": (
        """
    SELECT d.doc_id, d.text, CAST(CASE WHEN l.quality = 1 AND l.toxic = 1 THEN 3
        WHEN l.quality = 1 THEN 4 + d.doc_id % 2 ELSE 1 + d.doc_id % 2 END AS INTEGER) AS rating
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
        (),
    ),
    "opinions": (
        """
    SELECT doc_id, rating, CASE WHEN rating > 3 THEN 1 ELSE -1 END AS sentiment
    FROM reviews WHERE rating <> 3""",
        ("reviews",),
    ),
    "balanced": (balance_sql("opinions", "doc_id", "sentiment", BALANCE_SEED), ("opinions",)),
    "review_tokens": (
        f"SELECT doc_id, unnest({tokens_sql(clean_sql('text'))}) AS word FROM reviews",
        ("reviews",),
    ),
    "vocab": (
        f"""
    SELECT word, row_number() OVER (ORDER BY df DESC, word)::INTEGER AS idx FROM (
        SELECT word, count(DISTINCT doc_id) AS df FROM review_tokens
        GROUP BY word ORDER BY df DESC, word LIMIT {WORDS}) t""",
        ("review_tokens",),
    ),
    "docs": (
        f"SELECT doc_id, sentiment, {split_sql('doc_id', TRAIN_SHARE, SPLIT_SEED)} AS split FROM balanced",
        ("balanced",),
    ),
    "x": (
        """
    SELECT doc_id, 0 AS idx, 1.0::DOUBLE AS v FROM docs
    UNION ALL
    SELECT t.doc_id, v.idx, count(*)::DOUBLE FROM review_tokens t
    JOIN vocab v ON t.word = v.word JOIN docs d ON t.doc_id = d.doc_id GROUP BY t.doc_id, v.idx""",
        ("docs", "vocab"),
    ),
    "loans": (
        """
    SELECT o_orderkey AS loan_id, o_orderpriority AS purpose, c_mktsegment AS home_ownership,
        c_nationkey AS grade, o_totalprice AS amount, c_acctbal AS balance,
        CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS bad_loans,
        CASE WHEN o_orderstatus = 'P' THEN -1 ELSE 1 END AS safe_loans
    FROM orders JOIN customer ON o_custkey = c_custkey""",
        (),
    ),
    "even_loans": (balance_sql("loans", "loan_id", "safe_loans", BALANCE_SEED), ("loans",)),
    "loan_rows": (
        f"SELECT *, {split_sql("loan_id", TRAIN_SHARE, SPLIT_SEED)} AS split FROM even_loans",
        ("even_loans",),
    ),
    "flowers": (
        """
    SELECT vec_id AS flower_id, embedding[1]::DOUBLE AS x0, embedding[3]::DOUBLE AS x1,
        CASE WHEN label = 0 THEN -1 ELSE 1 END AS y, (label % 3)::INTEGER AS species FROM embeddings""",
        (),
    ),
    "scaled": (
        """
    SELECT flower_id, y, species,
        (x0 - avg(x0) OVER ()) / stddev_pop(x0) OVER () AS x0,
        (x1 - avg(x1) OVER ()) / stddev_pop(x1) OVER () AS x1 FROM flowers""",
        ("flowers",),
    ),
    "quadrants": (
        """
    SELECT point_id, x0, x1, CASE WHEN (x0 > 0) <> (x1 > 0) THEN 1 ELSE -1 END AS label
    FROM (SELECT vec_id AS point_id, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS x1 FROM embeddings) t""",
        (),
    ),
    "samples": (
        """
    SELECT event_id, ts, user_id, value / 100.0::DOUBLE AS x,
        CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS y FROM events""",
        (),
    ),
}


def with_sql(names: str, body: str, recursive: bool = False) -> str:
    """``body`` behind the common table expressions it needs, each computed once."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name not in ordered:
            for other in CTES[name][1]:
                need(other)
            ordered.append(name)

    for name in names.split():
        need(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][0]})" for n in ordered]
    start = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    if body.upper().startswith("WITH "):
        return start + ",\n".join(parts) + ",\n" + body[len("WITH "):]
    return start + ",\n".join(parts) + "\n" + body
