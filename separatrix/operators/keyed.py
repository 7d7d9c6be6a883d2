"""One perceptron or Adaline per key, exact in row order, over any number of epochs.

Rows are laid out by key and sorted inside their partition, and a task folds them as they
stream by: the weights of the current key go on from one Arrow batch to the next, and no
key's rows are gathered. An epoch is one job; weights travel back to the rows by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from separatrix.functions.hashing import key_digest
from separatrix.operators.adaline import descend
from separatrix.operators.perceptron import pass_over
from separatrix.storage import materialize, parallelism

Update = Callable[[np.ndarray, np.ndarray, np.ndarray, float], tuple[np.ndarray, float]]


def _fit(df: DataFrame, key: str, columns: Sequence[str], label: str, order_of: Callable[[int], list], extra: Sequence[str],
         update: Update, eta: float, epochs: int) -> DataFrame:
    names, size = list(columns), len(columns) + 1
    kind = df.schema[key].dataType.simpleString()
    doubles = [F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(names)]
    rows = df.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_y"), *doubles, *[F.col(c).alias(f"_o{j}") for j, c in enumerate(extra)])
    laid = rows.dropna(subset=["_key", "_y", *(f"_x{j}" for j in range(len(names)))]).repartition(parallelism(df), "_key")
    laid = laid.persist(StorageLevel.MEMORY_AND_DISK)
    schema = pa.schema([("key", laid.limit(0).toArrow().schema.field("_key").type), ("n", pa.int64()), ("w", pa.list_(pa.float64())), ("figures", pa.list_(pa.float64()))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n, w, figures, figure = None, 0, np.zeros(size), [], 0.0

        def record() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"key": current, "n": n, "w": w.tolist(), "figures": [*figures, figure]}], schema=schema)

        for batch in batches:
            keys = batch.column("_key").to_pylist()
            z = np.column_stack([np.ones(len(keys)), *(batch.column(f"_x{j}").to_numpy() for j in range(len(names)))])
            y = batch.column("_y").to_numpy()
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[start] != current:
                    if current is not None:
                        yield record()
                    held = batch.column("w")[start].as_py()
                    current, n, figure = keys[start], 0, 0.0
                    w, figures = (np.zeros(size), []) if held is None else (np.array(held), batch.column("figures")[start].as_py())
                w, more = update(z[start:end], y[start:end], w, eta)
                n, figure = n + end - start, figure + more
        if current is not None:
            yield record()

    try:
        weights = df.sparkSession.createDataFrame([], f"key {kind}, n long, w array<double>, figures array<double>")
        for epoch in range(1, epochs + 1):
            held = weights.select(F.col("key").alias("_of"), "w", "figures")
            joined = laid.join(held, F.col("_key") == F.col("_of"), "left").drop("_of")
            # Already laid out by key: the sort needs no shuffle.
            ready = joined.repartition(parallelism(df), "_key").sortWithinPartitions("_key", *order_of(epoch))
            weights = materialize(ready.mapInArrow(fold, weights.schema), "keyed-weights")
        return weights.withColumnRenamed("key", key)
    finally:
        laid.unpersist()


def perceptron_per_key(df: DataFrame, key: str, columns: Sequence[str], label: str, order: Sequence[str], eta: float = 0.01, epochs: int = 10) -> DataFrame:
    """``key, n, w, figures``: a perceptron for each key, its rows in ``order`` in every epoch.

    ``w`` has the intercept first, ``figures`` the number of updates of each epoch. Rows with a
    null key, label or feature take no part, and a key without other rows has no model.
    Memory does not grow with a key's rows, but one task takes all of them in turn, as
    each row's step depends on the one before.
    """
    return _fit(df, key, columns, label, lambda epoch: [f"_o{j}" for j in range(len(order))], order, pass_over, eta, epochs)


def stochastic_per_key(df: DataFrame, key: str, columns: Sequence[str], label: str, row_id: str, eta: float = 0.01, epochs: int = 10,
                       seed: int = 0) -> DataFrame:
    """``key, n, w, figures``: row-by-row descent for each key, in an order of its own for each epoch.

    The order is drawn from ``row_id``, seed and epoch. ``figures`` holds the mean cost of each
    epoch; the rest is as for ``perceptron_per_key``.
    """
    def order_of(epoch: int) -> list[Column]:
        return [key_digest("_o0", seed, epoch), F.col("_o0")]

    models = _fit(df, key, columns, label, order_of, [row_id], descend, eta, epochs)
    return models.withColumn("figures", F.transform("figures", lambda c: c / F.col("n")))
