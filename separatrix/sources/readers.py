"""Readers: stored tables, header-less CSV, JSON word lists, generated points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from separatrix.functions.vectors import exclusive_or


def load_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A stored columnar table; an explicit schema saves reading the footers."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_positional_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV without a header: columns get their names and types by position."""
    return spark.read.schema(schema).option("header", False).csv(path)


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """``(idx, word)`` from a JSON array of words, in the order of the array."""
    raw = spark.read.text(path, wholetext=True)
    words = F.from_json("value", "array<string>")
    return raw.select(F.posexplode(words).alias("idx", "word"))


def xor_label(x, y):
    """+1 when exactly one of two coordinates is positive, else -1."""
    return F.when(exclusive_or(x > 0, y > 0), 1).otherwise(-1)


def xor_points(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """``n`` standard normal points in the plane with their XOR label."""
    points = spark.range(n).select(
        "id", F.randn(seed).alias("x0"), F.randn(seed + 1).alias("x1")
    )
    return points.withColumn("label", xor_label(F.col("x0"), F.col("x1")))
