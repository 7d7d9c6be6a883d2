"""Queries: text cleaning and bags of words, over every document."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from separatrix.functions import text as tx
from separatrix.plans import fixtures as fx
from separatrix.plans.registry import query

# The twenty words of the small sentiment model.
SIGNIFICANT_WORDS = [
    "love", "great", "easy", "old", "little", "perfect", "loves", "well", "able", "car",
    "broke", "less", "even", "waste", "disappointed", "work", "product", "money", "would", "return",
]

_CLEAN = fx.clean_sql("text")
_TOKENS = fx.tokens_sql(_CLEAN)
_ALL_VOCAB = f"""
    all_tokens AS MATERIALIZED (SELECT doc_id, unnest({_TOKENS}) AS word FROM documents),
    all_vocab AS MATERIALIZED (
        SELECT word, df, (row_number() OVER (ORDER BY df DESC, word) - 1)::INTEGER AS idx FROM (
            SELECT word, count(DISTINCT doc_id) AS df FROM all_tokens
            GROUP BY word ORDER BY df DESC, word LIMIT {fx.WORDS}) t)"""


def _documents(spark, folder):
    return fx.documents(spark, folder).select("doc_id", tx.remove_punctuation("text").alias("clean"))


@query("E1", f"SELECT doc_id, {_CLEAN} AS clean FROM documents")
def cleaned_text(spark, folder):
    return _documents(spark, folder)


@query(
    "E2",
    f"""SELECT doc_id, word, count(*) AS n FROM (
        SELECT doc_id, unnest({fx.tokens_sql(f'lower({_CLEAN})')}) AS word FROM documents) t
        GROUP BY doc_id, word""",
)
def word_counts(spark, folder):
    return tx.word_counts(_documents(spark, folder), "doc_id", "clean")


@query(
    "E3",
    f"""WITH {_ALL_VOCAB}
    SELECT t.doc_id, v.idx, count(*) AS n FROM all_tokens t JOIN all_vocab v ON t.word = v.word GROUP BY t.doc_id, v.idx""",
)
def counts_of_given_words(spark, folder):
    """Counts of the most frequent words in every document, a row for each word that occurs in it."""
    documents = _documents(spark, folder)
    words = tx.vocabulary(documents, "clean", fx.WORDS)
    counted = tx.with_word_vector(documents, "clean", words).select("doc_id", vector_to_array("features").alias("v"))
    # Zeros go before the rows are made.
    numbered = F.transform("v", lambda n, i: F.struct(i.alias("idx"), n.cast("long").alias("n")))
    return counted.select("doc_id", F.inline(F.filter(numbered, lambda p: p["n"] > 0)))


def _in_list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_KEPT = ["the", "of", "and", "to", "in", "is", "que", "der", *SIGNIFICANT_WORDS]


def _trimmed_sql(negate: str) -> str:
    return f"""SELECT doc_id, word, count(*) AS n FROM (
        SELECT doc_id, unnest({fx.tokens_sql(f'lower({_CLEAN})')}) AS word FROM documents) t
        WHERE word {negate} IN ({_in_list(_KEPT)}) GROUP BY doc_id, word"""


def _trimmed(spark, folder, exclude: bool):
    maps = tx.word_count_map(_documents(spark, folder), "doc_id", "clean")
    kept = maps.select("doc_id", tx.trim_map("word_count", _KEPT, exclude).alias("m"))
    pairs = kept.select("doc_id", F.explode_outer("m").alias("word", "n"))
    return pairs.filter(F.col("word").isNotNull())


@query("E4", _trimmed_sql(""))
def map_keys_kept(spark, folder):
    return _trimmed(spark, folder, exclude=False)


@query("E4", _trimmed_sql("NOT"))
def map_keys_excluded(spark, folder):
    return _trimmed(spark, folder, exclude=True)


@query(
    "E5",
    f"""SELECT count(*) FILTER (list_contains({_TOKENS}, 'the')) AS with_word, count(*) AS n FROM documents""",
)
def rows_with_word(spark, folder):
    flagged = _documents(spark, folder).select(tx.has_word("clean", "the").alias("flag"))
    return flagged.agg(F.sum("flag").alias("with_word"), F.count("*").alias("n"))


@query("E6", f"WITH {_ALL_VOCAB} SELECT word, df FROM all_vocab")
def frequent_words(spark, folder):
    return tx.frequent_words(_documents(spark, folder), "clean", fx.WORDS)
