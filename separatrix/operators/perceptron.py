"""The perceptron: exact in row order, and parameter mixing for one-pass-per-epoch scale."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from separatrix.functions.hashing import stable_uniform
from separatrix.operators.models import LinearModel
from separatrix.storage import materialize

# Rows per chunk; a chunk is what one task holds in memory.
CHUNK_ROWS = 1_000_000
# Rows scored at once while looking for the next mistake.
LOOK_AHEAD = 256


def pass_over(z: np.ndarray, y: np.ndarray, w: np.ndarray, eta: float) -> tuple[np.ndarray, int]:
    """One sequential pass: weights move only at mistakes, so rows are scored in blocks
    and a block is scored again from the row after a mistake."""
    w, errors, at = w.copy(), 0, 0
    while at < len(y):
        block = slice(at, at + LOOK_AHEAD)
        predicted = np.where(z[block] @ w >= 0.0, 1.0, -1.0)
        wrong = np.flatnonzero(predicted != y[block])
        if not len(wrong):
            at += LOOK_AHEAD
            continue
        at += int(wrong[0])
        w += eta * (y[at] - predicted[wrong[0]]) * z[at]
        errors += 1
        at += 1
    return w, errors


def _arrays(pdf: pd.DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    z = np.column_stack([np.ones(len(pdf)), pdf[list(columns)].to_numpy(dtype=float)])
    return z, pdf["_y"].to_numpy(dtype=float)


def fit_ordered(df: DataFrame, columns: Sequence[str], label: str, order: Sequence[str],
                eta: float = 0.01, epochs: int = 10, chunk_rows: int = CHUNK_ROWS) -> LinearModel:
    """Exactly the sequential perceptron over all rows in ``order`` (a unique key).

    ``history`` is the number of updates per epoch. Rows go once into ordered
    chunks on the shared folder. A job runs several coming chunks at the current
    weights: all chunks up to the first one with a mistake are settled by it, as
    weights only move at mistakes. The number of chunks tried together doubles
    while no mistake turns up and drops to one after a mistake, so wasted work
    stays below the useful work and a nearly separated epoch takes few jobs.
    Rows with a null label or feature take no part.
    """
    names, keys = list(columns), list(order)
    rows = df.select(
        *keys, F.col(label).cast("double").alias("_y"), *[c for c in names if c not in keys]
    ).dropna(subset=["_y", *names])
    chunks = max(1, -(-rows.count() // chunk_rows))
    if chunks == 1:
        table, sweeps_per_job = rows.withColumn("_chunk", F.lit(0)), epochs
    else:
        ranged = rows.repartitionByRange(chunks, *keys).withColumn("_chunk", F.spark_partition_id())
        table, sweeps_per_job = materialize(ranged, "perceptron", "_chunk"), 1

    def attempt(first: int, last: int, w: np.ndarray):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            z, y = _arrays(pdf.sort_values(keys), names)
            weights, errors = w, []
            for _ in range(sweeps_per_job):
                weights, e = pass_over(z, y, weights, eta)
                errors.append(e)
            return pd.DataFrame(
                {"chunk": [int(pdf["_chunk"].iloc[0])], "errors": [errors], "w": [weights.tolist()]}
            )

        coming = table.filter((F.col("_chunk") >= first) & (F.col("_chunk") < last))
        done = coming.groupBy("_chunk").applyInPandas(run, "chunk int, errors array<long>, w array<double>")
        return sorted(done.collect(), key=lambda r: r["chunk"])

    w = np.zeros(len(names) + 1)
    if chunks == 1:
        for r in attempt(0, 1, w):
            w = np.array(r["w"])
            return LinearModel(names, w.tolist(), list(r["errors"]))
        return LinearModel(names, w.tolist(), [0] * epochs)

    history: list[int] = []
    while len(history) < epochs:
        at, ahead, errors = 0, 1, 0
        while at < chunks:
            last = min(chunks, at + ahead)
            wrong = next((r for r in attempt(at, last, w) if r["errors"][0]), None)
            if wrong is None:
                at, ahead = last, ahead * 2
                continue
            w = np.array(wrong["w"])
            errors += wrong["errors"][0]
            at, ahead = wrong["chunk"] + 1, 1
        history.append(errors)
        if errors == 0:
            history += [0] * (epochs - len(history))
    return LinearModel(names, w.tolist(), history)


def fit_mixing(df: DataFrame, columns: Sequence[str], label: str, key: str, eta: float = 0.01,
               epochs: int = 10, shards: int = 8, seed: int = 0) -> LinearModel:
    """Iterative parameter mixing (McDonald, Hall, Mann 2010).

    A digest of key and seed deals the rows to ``shards``. Every shard runs an epoch on its
    own rows in key order, then the weights are averaged; shards with rows count alike,
    whatever their number of rows. The result depends on nothing else, so ``shards`` should
    grow with the table. It separates separable data, with other weights than the
    sequential learner. Each epoch is one job that brings ``shards`` small vectors to the
    driver. Rows with a null key, label or feature take no part.
    """
    names = list(columns)
    shard = F.floor(stable_uniform(key, seed) * shards).cast("int")
    rows = (
        df.select(key, F.col(label).cast("double").alias("_y"), *names)
        .dropna(subset=[key, "_y", *names])
        .repartitionById(shards, shard)
        .sortWithinPartitions(key)
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    w = np.zeros(len(names) + 1)
    history = []
    try:
        for _ in range(epochs):
            start = w

            def run(frames):
                weights, errors, seen = start, 0, 0
                for pdf in frames:
                    weights, e = pass_over(*_arrays(pdf, names), weights, eta)
                    errors, seen = errors + e, seen + len(pdf)
                if seen:
                    yield pd.DataFrame({"errors": [errors], "w": [weights.tolist()]})

            mixed = rows.mapInPandas(run, "errors long, w array<double>").collect()
            if mixed:
                w = np.mean([r["w"] for r in mixed], axis=0)
            history.append(sum(r["errors"] for r in mixed))
    finally:
        rows.unpersist()
    return LinearModel(names, w.tolist(), history)
