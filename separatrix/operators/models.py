"""Trained linear models: scoring, coefficients, training history."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from separatrix.functions.vectors import affine, sign_inclusive
from separatrix.operators.tables import INTERCEPT


@dataclass
class LinearModel:
    """Weights over named columns, intercept first, with one figure per epoch."""

    columns: list[str]
    weights: list[float]
    history: list[float] = field(default_factory=list)

    def score(self) -> Column:
        return affine(self.columns, self.weights)

    def predict(self) -> Column:
        return sign_inclusive(self.score())

    def coefficients(self, spark: SparkSession) -> DataFrame:
        return coefficient_frame(spark, self.columns, self.weights)

    def epochs(self, spark: SparkSession, figure: str = "cost") -> DataFrame:
        """``(epoch, figure)`` with epochs from 1 on."""
        rows = [(n, float(v)) for n, v in enumerate(self.history, 1)]
        return spark.createDataFrame(rows, f"epoch int, {figure} double")


def coefficient_frame(spark: SparkSession, names: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """``(idx, name, value)`` of a model, the intercept at index 0."""
    table = pa.table(
        {
            "idx": pa.array(range(len(weights)), pa.int32()),
            "name": pa.array([INTERCEPT, *names], pa.string()),
            "value": pa.array([float(w) for w in weights], pa.float64()),
        }
    )
    return spark.createDataFrame(table)


def weight_signs(coefficients: DataFrame) -> DataFrame:
    """How many weights are at least 0, below 0, and in total."""
    return coefficients.agg(
        F.count_if(F.col("value") >= 0).alias("non_negative"),
        F.count_if(F.col("value") < 0).alias("negative"),
        F.count("*").alias("total"),
    )
