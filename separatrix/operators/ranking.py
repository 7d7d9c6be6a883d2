"""Sorted views, top and bottom rows, strongest words, best model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sort_desc(df: DataFrame, column: str, key: str) -> DataFrame:
    """All rows from the largest value down; the key breaks ties."""
    return df.orderBy(F.desc(column), key)


def top_k(df: DataFrame, column: str, k: int, key: str, reverse: bool = False) -> DataFrame:
    """The ``k`` rows with the largest value, or the smallest with ``reverse``."""
    order = F.asc(column) if reverse else F.desc(column)
    return df.orderBy(order, F.asc(key)).limit(k)


def strongest_words(coefficients: DataFrame, k: int) -> DataFrame:
    """The ``k`` most positive and most negative words; the intercept does not count."""
    words = coefficients.filter(F.col("idx") > 0)
    positive = top_k(words, "value", k, "word").withColumn("direction", F.lit("positive"))
    negative = top_k(words, "value", k, "word", reverse=True)
    return positive.unionByName(negative.withColumn("direction", F.lit("negative")))


def best_penalty(report: DataFrame, measure: str = "validation_accuracy") -> DataFrame:
    """The row with the best measure; the smallest penalty wins ties."""
    return report.orderBy(F.desc(measure), "l2").limit(1)
