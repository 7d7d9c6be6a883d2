"""Multinomial logistic regression by Newton's method, to the optimum.

One job for each step: tasks add up gradient, curvature and the loss at several step
sizes; the driver solves a system as large as the model. The result is the minimum itself,
so it can be checked without replaying the way to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from separatrix.functions.vectors import affine
from separatrix.operators.tables import INTERCEPT

# Weights of a model: its curvature has this number squared.
MOST_WEIGHTS = 2000
# Step sizes whose loss is measured in one pass.
STEPS = (1.0, 0.5, 0.25, 0.0625, 0.0078125)


@dataclass
class ClassModel:
    """One weight vector per class, intercept first; they add up to zero over the classes."""

    columns: list[str]
    classes: list[float]
    weights: np.ndarray
    loss: float
    gradient: float  # largest component at the end

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """``(class, idx, name, value)``."""
        names = [INTERCEPT, *self.columns]
        rows = [(c, j, n, float(w[j])) for c, w in zip(self.classes, self.weights, strict=True) for j, n in enumerate(names)]
        return spark.createDataFrame(rows, "class double, idx int, name string, value double")

    def scores(self) -> list[Column]:
        return [affine(self.columns, w.tolist()) for w in self.weights]

    def predict(self) -> Column:
        """The class with the largest score; the first of equal ones."""
        scores = self.scores()
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        chosen = F.lit(None).cast("double")
        for c, s in reversed(list(zip(self.classes, scores, strict=True))):
            chosen = F.when(s == best, F.lit(c)).otherwise(chosen)
        return chosen


def _losses(z: np.ndarray, own: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Probabilities of all classes, and the sum of negative log likelihoods."""
    s = z @ w.T
    s -= s.max(axis=1, keepdims=True)
    p = np.exp(s)
    total = p.sum(axis=1, keepdims=True)
    return p / total, float((np.log(total[:, 0]) - s[np.arange(len(z)), own]).sum())


def fit_classes(df: DataFrame, columns: Sequence[str], label: str, c: float = 1000.0, tolerance: float = 1e-9, most: int = 50) -> ClassModel:
    """Minimum of the summed log loss plus ``1 / (2 c)`` times the squared weights but for intercepts.

    Steps follow the curvature, shortened where the loss would not fall, until no component
    of the gradient per row is above ``tolerance``. Rows with a null label or feature take no
    part. Of weights that differ by a vector common to all classes, those adding up to zero
    are taken; two classes give weights of opposite signs.
    """
    names, size = list(columns), len(columns) + 1
    doubles = [F.col(x).cast("double").alias(x) for x in names]
    rows = df.select(F.col(label).cast("double").alias("_y"), *doubles).dropna().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = rows.groupBy("_y").agg(F.count("*").alias("n")).orderBy("_y").limit(MOST_WEIGHTS + 1).collect()
        classes, n = [r["_y"] for r in counts], sum(r["n"] for r in counts)
        k = len(classes)
        if k * size > MOST_WEIGHTS:
            raise ValueError(f"{k} classes of {size} weights exceed {MOST_WEIGHTS}")
        free = np.ones(size)
        free[0] = 0.0
        w, direction, loss, steepest = np.zeros((k, size)), np.zeros((k, size)), np.inf, 0.0
        for _ in range(most if k > 1 else 0):
            losses, grads, curves = _pass(rows, names, classes, [w + t * direction for t in STEPS])
            penalized = [x + ((w + t * direction)[:, 1:] ** 2).sum() / (2 * c) for t, x in zip(STEPS, losses, strict=True)]
            best = int(np.argmin(penalized))
            if penalized[best] >= loss and direction.any():
                break  # rounding: no step is better any more
            w, loss = w + STEPS[best] * direction, penalized[best]
            gradient = grads[best] + w * free / c
            steepest = float(np.abs(gradient).max())
            if steepest <= tolerance * n:
                break
            curve = curves[best] + np.diag(np.tile(free / c, k))
            direction = -(np.linalg.pinv(curve, hermitian=True) @ gradient.ravel()).reshape(k, size)
            direction -= direction.mean(axis=0)
    finally:
        rows.unpersist()
    return ClassModel(names, classes, w, float(loss), steepest)


def _pass(rows: DataFrame, names: list[str], classes: list[float], candidates: list[np.ndarray]):
    """Loss, gradient and curvature at each candidate, summed over all rows on the executors."""
    k, size = candidates[0].shape
    cells = 1 + k * size + (k * size) ** 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(candidates), cells))
        for batch in batches:
            z = np.column_stack([np.ones(batch.num_rows), *(batch.column(c).to_numpy() for c in names)])
            own = np.searchsorted(classes, batch.column("_y").to_numpy())
            for at, w in enumerate(candidates):
                p, loss = _losses(z, own, w)
                wrong = p.copy()
                wrong[np.arange(len(z)), own] -= 1.0
                curve = np.zeros((k, size, k, size))
                for a in range(k):
                    for b in range(k):
                        weight = p[:, a] * ((a == b) - p[:, b])
                        curve[a, :, b, :] = z.T @ (z * weight[:, None])
                sums[at] += np.concatenate(([loss], (wrong.T @ z).ravel(), curve.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["cell", "v"])

    found = rows.mapInArrow(partial, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    sums = np.zeros(len(candidates) * cells)
    sums[found.column("cell").to_numpy()] = found.column("v").to_numpy()
    sums = sums.reshape(len(candidates), cells)
    grads = [s[1 : 1 + k * size].reshape(k, size) for s in sums]
    return sums[:, 0], grads, [s[1 + k * size :].reshape(k * size, k * size) for s in sums]
