"""Text cleaning and bags of words, all inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, functions as F

from separatrix.functions.hashing import _col

# The 32 ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# The white space of Python's str.split() that is not in Java's \s.
RARE_SPACES = (
    "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def remove_punctuation(text) -> Column:
    """Delete ASCII punctuation; every other symbol stays."""
    return F.translate(_col(text), PUNCTUATION, "")


def tokens(text, lower: bool = False) -> Column:
    """White-space tokens of a text, without empty strings; null for a null text.

    Splitting at ``\\s`` is several times faster than at the full list of spaces,
    so the rare ones are replaced first, in the texts that have any.
    """
    text = F.lower(_col(text)) if lower else _col(text)
    plain = F.translate(text, RARE_SPACES, " " * len(RARE_SPACES))
    text = F.when(F.rlike(text, F.lit(f"[{RARE_SPACES}]")), plain).otherwise(text)
    return F.array_remove(F.split(text, r"\s+"), "")


def exploded(df: DataFrame, column: str) -> DataFrame:
    """One row per element of an array column.

    A plain ``explode`` makes the optimizer add a filter on the array's size, which
    computes an expensive array twice, and below any exchange. The outer form has
    no such filter; the rows it adds for empty arrays are dropped here.
    """
    return df.withColumn(column, F.explode_outer(column)).filter(F.col(column).isNotNull())


def with_word_runs(df: DataFrame, text, lower: bool = True) -> DataFrame:
    """Add ``_words`` and ``_counts``: the distinct words of a text and how often each occurs.

    Equal words are neighbours in the sorted tokens, so a word's count is the
    distance between the ends of two runs. All of it happens inside a row: a
    text is counted whole and nothing is shuffled.
    """
    return with_token_runs(df, tokens(text, lower))


def with_token_runs(df: DataFrame, listed: Column) -> DataFrame:
    """``with_word_runs`` of an array of tokens."""
    ordered = df.withColumn("_sorted", F.sort_array(listed))

    def end_of_run(word: Column, at: Column) -> Column:
        last = F.coalesce(F.get("_sorted", at + 1) != word, F.lit(True))
        return F.when(last, at + 1)

    ends = ordered.withColumn("_ends", F.array_compact(F.transform("_sorted", end_of_run)))
    return ends.withColumns(
        {
            "_words": F.transform("_ends", lambda end: F.get("_sorted", end - 1)),
            "_counts": F.transform(
                "_ends",
                lambda end, n: (end - F.coalesce(F.get("_ends", n - 1), F.lit(0))).cast("long"),
            ),
        }
    ).drop("_sorted", "_ends")


def word_counts(df: DataFrame, key: str, text, lower: bool = True) -> DataFrame:
    """``(key, word, n)``, one row per distinct word of a row's text."""
    runs = with_word_runs(df, text, lower)
    pairs = exploded(runs.select(key, F.arrays_zip("_words", "_counts").alias("p")), "p")
    return pairs.select(key, F.col("p._words").alias("word"), F.col("p._counts").alias("n"))


def word_count_map(df: DataFrame, key: str, text, lower: bool = True) -> DataFrame:
    """``(key, word_count)`` with a word-to-count map; rows without words get an empty map."""
    runs = with_word_runs(df, text, lower)
    empty = F.expr("cast(map() as map<string,bigint>)")
    counted = F.coalesce(F.map_from_arrays("_words", "_counts"), empty)
    return runs.select(key, counted.alias("word_count"))


def trim_map(word_count, keys: Sequence[str], exclude: bool = False) -> Column:
    """Keep only the given keys of a map, or drop them with ``exclude``."""
    wanted = list(keys)
    if exclude:
        return F.map_filter(word_count, lambda k, _: ~k.isin(wanted))
    return F.map_filter(word_count, lambda k, _: k.isin(wanted))


def counter_for(words: Sequence[str], input_col: str, output_col: str) -> CountVectorizerModel:
    """Model that counts exactly the given words, in their order, in a token array.

    It runs per row, without a shuffle, whatever the number of words.
    """
    return CountVectorizerModel.from_vocabulary(list(words), input_col, output_col)


def with_word_vector(
    df: DataFrame, text, words: Sequence[str], output: str = "features", lower: bool = False
) -> DataFrame:
    """Add the sparse vector of counts of ``words`` in the text (case-sensitive by default)."""
    listed = F.coalesce(tokens(text, lower), F.array().cast("array<string>"))
    counted = counter_for(words, "_tokens", output).transform(df.withColumn("_tokens", listed))
    return counted.drop("_tokens")


def has_word(text, word: str) -> Column:
    """1 if the word is among the tokens, else 0."""
    return F.coalesce(F.array_contains(tokens(text), word), F.lit(False)).cast("int")


def document_frequency(df: DataFrame, text) -> DataFrame:
    """``(word, df)``: number of rows whose text has the word."""
    words = exploded(df.select(F.array_distinct(tokens(text)).alias("word")), "word")
    return words.groupBy("word").agg(F.count("*").alias("df"))


def frequent_words(df: DataFrame, text, k: int) -> DataFrame:
    """The ``k`` words with the highest document frequency, ties in word order."""
    return document_frequency(df, text).orderBy(F.desc("df"), "word").limit(k)


def vocabulary(df: DataFrame, text, k: int) -> list[str]:
    """``frequent_words`` as an ordered list of ``k`` words for the driver."""
    return [r["word"] for r in frequent_words(df, text, k).collect()]
