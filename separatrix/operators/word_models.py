"""Logistic regression on word counts whose weights are a table.

No list of words is in the driver or in a task: weights have a row for each word, margins
and gradients are joins and sums, and each pass writes the weights that the next one reads.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from separatrix.functions.text import word_counts
from separatrix.functions.vectors import link
from separatrix.operators.tables import INTERCEPT
from separatrix.storage import materialize


@dataclass
class WordModel:
    """``weights`` has a row ``(word, value)`` for each word of the training rows."""

    intercept: float
    weights: DataFrame

    def coefficients(self) -> DataFrame:
        """``(word, value)`` of all words, and of the intercept under its name and ``is_intercept``."""
        first = self.weights.sparkSession.range(1).select(F.lit(INTERCEPT).alias("word"), F.lit(self.intercept).alias("value"), F.lit(True).alias("is_intercept"))
        return self.weights.withColumn("is_intercept", F.lit(False)).unionByName(first)

    def margins(self, df: DataFrame, key: str, text: str | Column, lower: bool = True) -> DataFrame:
        """``(key, margin)`` of each row; words without a weight count nothing."""
        known = _margins(word_counts(df, key, text, lower), self.weights, key)
        return df.select(key).join(known, key, "left").select(key, (F.coalesce("s", F.lit(0.0)) + F.lit(self.intercept)).alias("margin"))


def _margins(counts: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    # A common word is in many rows: Spark broadcasts few weights and splits the word's rows otherwise.
    return counts.join(weights, "word").groupBy(key).agg(F.sum(F.col("n") * F.col("value")).alias("s"))


def fit_words(df: DataFrame, key: str, text: str | Column, label: str, step: float, iterations: int, penalty: float = 0.0, lower: bool = True) -> WordModel:
    """Gradient ascent from zero weights on the counts of all words, as ``logistic.fit_path`` does it on vectors.

    The gradient is summed over rows, less ``2 * penalty * w`` but for the intercept. ``key``
    must be unique. Rows with a null label take no part; a null text has no words. Each pass
    is two joins: weights with counts by word, errors with counts by row.
    """
    rows = df.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    stored = rows.select(key, (F.col(label) == 1).cast("double").alias("_y")).persist(StorageLevel.MEMORY_AND_DISK)
    counts = materialize(word_counts(rows, key, text, lower), "word-counts")
    weights = materialize(counts.select("word").distinct().withColumn("value", F.lit(0.0)), "word-weights")
    intercept = 0.0
    try:
        for _ in range(iterations):
            score = F.coalesce("s", F.lit(0.0)) + F.lit(intercept)
            scored = stored.join(_margins(counts, weights, key), key, "left")
            errors = materialize(scored.select(key, (F.col("_y") - link(score)).alias("_e")), "word-errors")
            slopes = counts.join(errors, key).groupBy("word").agg(F.sum(F.col("n") * F.col("_e")).alias("g"))
            moved = F.col("value") + F.lit(step) * (F.coalesce("g", F.lit(0.0)) - F.lit(2.0 * penalty) * F.col("value"))
            weights = materialize(weights.join(slopes, "word", "left").select("word", moved.alias("value")), "word-weights")
            intercept += step * (errors.agg(F.sum("_e")).first()[0] or 0.0)
    finally:
        stored.unpersist()
    return WordModel(intercept, weights)
