"""Projection, selection and shaping of feature tables."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from separatrix.functions.hashing import _col

INTERCEPT = "(intercept)"


def coefficient_words(spark: SparkSession, words: Sequence[str]) -> DataFrame:
    """``(idx, word)`` of a linear model: the intercept, then the words in order."""
    named = [INTERCEPT, *words]
    table = pa.table({"idx": pa.array(range(len(named)), pa.int32()), "word": pa.array(named, pa.string())})
    return spark.createDataFrame(table)


def preview(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """First ``n`` rows in key order."""
    return df.orderBy(key).limit(n)


def row_slice(df: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """Rows ``start`` to ``stop - 1`` in key order, as ``df[start:stop]``.

    Each task keeps ``stop`` rows at most, so the cut is cheap near the head.
    """
    return df.orderBy(key).offset(start).limit(stop - start)


def rating_sentiment(rating) -> Column:
    """+1 for ratings above 3, else -1."""
    return F.when(_col(rating) > 3, 1).otherwise(-1)


def safe_label(bad_flag) -> Column:
    """+1 for flag 0 (safe), else -1 (risky)."""
    return F.when(_col(bad_flag) == 0, 1).otherwise(-1)


def drop_neutral(df: DataFrame, rating: str = "rating") -> DataFrame:
    """Drop the rows with rating 3; null ratings go too."""
    return df.filter(F.col(rating) != 3)


def filter_by(df: DataFrame, column: str, values: Sequence | DataFrame) -> DataFrame:
    """Keep rows whose column is in a short list, or in a one-column table."""
    if isinstance(values, DataFrame):
        listed = values.select(F.col(values.columns[0]).alias(column))
        return df.join(listed, column, "left_semi")
    return df.filter(F.col(column).isin(list(values)))


def with_intercept(df: DataFrame, name: str = "intercept") -> DataFrame:
    """Add the constant column 1."""
    return df.select(F.lit(1.0).alias(name), "*")


def assemble(df: DataFrame, key: str, features: Sequence[str], label: str) -> DataFrame:
    """``(key, label, features)`` with the constant 1 as the first of the features."""
    row = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features])
    return df.select(key, F.col(label).alias("label"), row.alias("features"))


def shape(df: DataFrame) -> DataFrame:
    """One row: ``rows``, ``cols`` and ``size`` of a table."""
    width = len(df.columns)
    return df.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(width).alias("cols"), (F.col("rows") * width).alias("size")
    )


def column_names(df: DataFrame) -> DataFrame:
    """``(position, column_name)`` of a table, from its schema alone."""
    named = F.array(*[F.lit(c) for c in df.columns])
    return df.sparkSession.range(1).select(F.posexplode(named).alias("position", "column_name"))


def classes(df: DataFrame, label: str) -> DataFrame:
    """The distinct labels in order."""
    return df.select(label).distinct().orderBy(label)


def attach_coefficients(table: DataFrame, coefficients: DataFrame, name: str) -> DataFrame:
    """Add a model's coefficients as a column, matched by index and not by position."""
    values = coefficients.select("idx", F.col("value").alias(name))
    return table.join(values, "idx", "left")


def coefficient_table(coefficients: DataFrame, penalties: Sequence[float]) -> DataFrame:
    """Wide table ``(idx, word, one column per penalty)`` from long coefficients."""
    columns = [
        F.max(F.when(F.col("l2") == float(p), F.col("value"))).alias(f"l2_{p:g}")
        for p in penalties
    ]
    return coefficients.groupBy("idx", "word").agg(*columns)


def append(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both tables, duplicates kept, columns matched by name."""
    return first.unionByName(second)


def standardize(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Replace columns by their z-scores (population deviation).

    ``fitted_on`` takes mean and deviation from another table, such as the
    training part. All statistics come from one aggregate over the columns in
    use; a constant column becomes null.
    """
    source = df if fitted_on is None else fitted_on
    stats = source.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
    )
    scaled = {
        c: (F.col(c) - stats.select(f"mean_{c}").scalar())
        / F.nullif(stats.select(f"std_{c}").scalar(), F.lit(0.0))
        for c in columns
    }
    return df.withColumns(scaled)


def extents(df: DataFrame, columns: Sequence[str], margin: float = 1.0) -> DataFrame:
    """One row with ``{column}_lo`` and ``{column}_hi``, widened by a margin."""
    return df.agg(
        *[(F.min(c) - F.lit(margin)).alias(f"{c}_lo") for c in columns],
        *[(F.max(c) + F.lit(margin)).alias(f"{c}_hi") for c in columns],
    )
