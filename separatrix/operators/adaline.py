"""Adaptive linear neuron: batch gradient descent and exact row-by-row descent.

Both learners are linear in the weights, which is what makes them distributable.

* Batch descent needs only the sums ``Z'Z``, ``Z'y`` and ``y'y`` with ``Z = [1, X]``.
  One job collects them; every epoch is then arithmetic on a small matrix.
* Row-by-row descent maps weights to ``A w + b`` at every row. Such maps compose,
  so each range partition of the ordered rows reduces to one small map plus the
  sums that give its cost. Neighbouring maps are composed on the executors until one
  is left. The result equals a sequential run over all rows, up to rounding.

Rows without a label or with a null feature take no part in either.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from separatrix.functions.hashing import key_digest, stable_uniform
from separatrix.operators.logistic import scores, unpack
from separatrix.operators.models import LinearModel
from separatrix.storage import parallelism

# Up to this many features the moments are one generated aggregate.
AGGREGATE_LIMIT = 16
# Beyond so many features, moments are larger than the gradients they save.
MOMENT_LIMIT = 2000
# Rows per triangular solve in a row-by-row sweep.
BLOCK = 64
# Neighbouring maps that one task composes.
FAN_IN = 8


def _matrix(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """``[1, x1, ..., xd]`` of a batch, one row per record."""
    cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
    return np.column_stack([np.ones(batch.num_rows), *cols]).astype(float)


def _labelled(df: DataFrame, columns: Sequence[str], label: str, *more) -> DataFrame:
    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    rows = df.select(F.col(label).cast("double").alias("_y"), *doubles, *more)
    return rows.dropna(subset=["_y", *columns])


def moments(df: DataFrame, columns: Sequence[str], label: str) -> np.ndarray:
    """``[Z y]' [Z y]`` of the whole table in one job, as a ``(d+2, d+2)`` array.

    It goes through the driver, so more than ``MOMENT_LIMIT`` features are an error;
    ``fit_batch_vectors`` takes any number.
    """
    if len(columns) > MOMENT_LIMIT:
        raise ValueError(f"{len(columns)} features exceed {MOMENT_LIMIT}; put them into vectors")
    rows = _labelled(df, columns, label)
    size = len(columns) + 2
    if len(columns) <= AGGREGATE_LIMIT:
        z = [F.lit(1.0), *[F.col(c) for c in columns], F.col("_y")]
        upper = [(i, j) for i in range(size) for j in range(i, size)]
        sums = rows.agg(*[F.sum(z[i] * z[j]).alias(f"m_{i}_{j}") for i, j in upper]).first()
        out = np.zeros((size, size))
        for (i, j), v in zip(upper, sums, strict=True):
            out[i, j] = out[j, i] = v or 0.0
        return out

    names = list(columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            zy = np.column_stack([_matrix(batch, names), batch.column("_y").to_numpy()])
            total += zy.T @ zy
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size * size)), pa.array(total.ravel())], names=["cell", "v"]
        )

    cells = rows.mapInArrow(partial, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size * size)
    out[cells.column("cell").to_numpy()] = cells.column("v").to_numpy()
    return out.reshape(size, size)


def fit_batch(df: DataFrame, columns: Sequence[str], label: str, eta: float = 0.01,
              epochs: int = 10) -> LinearModel:
    """Batch gradient descent with the summed gradient; ``history`` is the cost before each update."""
    m = moments(df, columns, label)
    gram, cross, square = m[:-1, :-1], m[:-1, -1], m[-1, -1]
    w = np.zeros(len(columns) + 1)
    history = []
    for _ in range(epochs):
        history.append(0.5 * (square - 2.0 * w @ cross + w @ gram @ w))
        w = w + eta * (cross - gram @ w)
    return LinearModel(list(columns), w.tolist(), history)


def fit_batch_vectors(df: DataFrame, features: str, label: str, width: int, eta: float = 0.01, epochs: int = 10) -> LinearModel:
    """Batch gradient descent on vectors of any width, dense or sparse: no cell for a pair of features.

    Each epoch is one job. Tasks add up the gradient of their rows, of stored entries only,
    and executors add up the tasks' sums by feature; what returns is as long as the weights.
    ``history`` is the cost before each update. Rows with a null label or null features take
    no part, and a vector of another size is an error.
    """
    rows = df.select(F.col(label).cast("double").alias("_y"), F.col(features).alias("_x")).dropna().persist(StorageLevel.MEMORY_AND_DISK)
    w, history = np.zeros(width + 1), []
    try:
        for _ in range(epochs):
            shared = df.sparkSession.sparkContext.broadcast(w)

            def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                weights = shared.value
                grad, square = np.zeros(len(weights)), 0.0
                for batch in batches:
                    vectors = batch.column("_x")
                    row, idx, value = unpack(vectors)
                    dense = vectors.field("type").to_numpy(zero_copy_only=False) == 1
                    sizes = np.where(dense, np.bincount(row, minlength=batch.num_rows), vectors.field("size").fill_null(0).to_numpy())
                    if (sizes != width).any():
                        raise ValueError(f"vectors of length {sorted(set(sizes.tolist()) - {width})}, expected {width}")
                    error = batch.column("_y").to_numpy() - scores(row, idx, value, batch.num_rows, weights)
                    grad[0] += error.sum()
                    grad[1:] += np.bincount(idx, weights=value * error[row], minlength=width)
                    square += float(error @ error)
                at = np.flatnonzero(grad)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(grad[at], square))], ["idx", "v"])

            found = rows.mapInArrow(partial, "idx long, v double").groupBy("idx").agg(F.sum("v").alias("v")).toArrow()
            shared.destroy()
            idx, v = (found.column(c).to_numpy() for c in ("idx", "v"))
            history.append(0.5 * float(v[idx == -1].sum()))
            w = w.copy()
            w[idx[idx >= 0]] += eta * v[idx >= 0]
    finally:
        rows.unpersist()
    return LinearModel([f"x{j}" for j in range(width)], w.tolist(), history)


@dataclass
class Sweep:
    """Row-by-row descent over some rows, as a function of the weights it starts from.

    End weights are ``a @ w + b``; the errors are ``g0 - g @ w`` and only the sums
    ``errors_gram`` of ``[g0 g]`` are kept.
    """

    a: np.ndarray
    b: np.ndarray
    errors_gram: np.ndarray
    rows: int = 0

    @classmethod
    def empty(cls, size: int) -> Sweep:
        return cls(np.eye(size), np.zeros(size), np.zeros((size + 1, size + 1)))

    def extend(self, z: np.ndarray, y: np.ndarray, eta: float) -> None:
        """Append a block of rows. Errors solve ``(I + eta L) e = y - Z w`` with
        ``L`` the part of ``Z Z'`` below its diagonal."""
        triangle = np.eye(len(y)) + eta * np.tril(z @ z.T, -1)
        solved = np.linalg.solve(triangle, np.column_stack([y, z]))
        c, g = solved[:, 0], solved[:, 1:]
        errors = np.column_stack([c - g @ self.b, g @ self.a])
        self.errors_gram += errors.T @ errors
        step = eta * z.T
        block_a, block_b = np.eye(z.shape[1]) - step @ g, step @ c
        self.a, self.b = block_a @ self.a, block_a @ self.b + block_b
        self.rows += len(y)

    def then(self, later: Sweep) -> Sweep:
        """Both sweeps as one: this one first."""
        # What the later sweep starts from, in terms of [1, -w] at the start of this one.
        start = np.zeros((len(self.b) + 1, len(self.b) + 1))
        start[0, 0], start[1:, 0], start[1:, 1:] = 1.0, -self.b, self.a
        gram = self.errors_gram + start.T @ later.errors_gram @ start
        return Sweep(later.a @ self.a, later.a @ self.b + later.b, gram, self.rows + later.rows)

    def record(self) -> dict:
        return {"n": self.rows, "a": self.a.ravel(), "b": self.b, "m": self.errors_gram.ravel()}

    @classmethod
    def of(cls, record) -> Sweep:
        b = np.array(record["b"])
        return cls(
            np.array(record["a"]).reshape(len(b), len(b)), b,
            np.array(record["m"]).reshape(len(b) + 1, len(b) + 1), int(record["n"]),
        )

    def run(self, w: np.ndarray) -> tuple[np.ndarray, float]:
        """End weights and half the sum of squared errors."""
        v = np.concatenate([[1.0], -w])
        return self.a @ w + self.b, 0.5 * float(v @ self.errors_gram @ v)


def descend(z: np.ndarray, y: np.ndarray, w: np.ndarray, eta: float) -> tuple[np.ndarray, float]:
    """Row-by-row descent over rows ``z`` (with the constant) from weights ``w``: end weights, half the sum of squared errors.

    A block's errors solve one triangular system, as in ``Sweep.extend``, so no map is needed.
    """
    cost = 0.0
    for start in range(0, len(y), BLOCK):
        part = z[start:start + BLOCK]
        errors = np.linalg.solve(np.eye(len(part)) + eta * np.tril(part @ part.T, -1), y[start:start + BLOCK] - part @ w)
        w = w + eta * errors @ part
        cost += 0.5 * float(errors @ errors)
    return w, cost


RECORD = "n long, a array<double>, b array<double>, m array<double>"


def composed(group: pd.DataFrame) -> Sweep:
    """The maps of a group as one, in the order of ``part``."""
    sweeps = [Sweep.of(r) for r in group.sort_values("part").to_dict("records")]
    out = sweeps[0]
    for later in sweeps[1:]:
        out = out.then(later)
    return out


def sweep_over(df: DataFrame, columns: Sequence[str], label: str, order: Sequence, eta: float,
               place: Column | None = None) -> Sweep:
    """All rows in order as one ``Sweep``.

    Each range partition of the ordered rows becomes one, and tasks compose neighbours,
    so the driver gets a single map however many partitions or features there are.
    ``place`` is a uniform number in [0, 1) that grows with the order, if there is
    one; it gives the partition directly, without a job that samples the order.
    """
    names, size = list(columns), len(columns) + 1
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    order_names = [f"_o{n}" for n in range(len(keys))]
    extra = [k.alias(n) for k, n in zip(keys, order_names, strict=True)]
    if place is not None:
        extra.append(place.alias("_place"))
    rows = _labelled(df, names, label, *extra)

    def reduce_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep.empty(size)
        for batch in batches:
            z, y = _matrix(batch, names), batch.column("_y").to_numpy()
            for start in range(0, len(y), BLOCK):
                sweep.extend(z[start:start + BLOCK], y[start:start + BLOCK], eta)
        if sweep.rows:
            part = {"part": TaskContext.get().partitionId(), **sweep.record()}
            yield pa.RecordBatch.from_pylist([part], schema=arrow)

    doubles = pa.list_(pa.float64())
    arrow = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("a", doubles), ("b", doubles), ("m", doubles)])
    chunks = parallelism(df)
    if place is None:
        ranged = rows.repartitionByRange(chunks, *order_names)
    else:
        ranged = rows.repartitionById(chunks, F.floor(F.col("_place") * chunks).cast("int"))
    parts = (
        ranged.sortWithinPartitions(*order_names)
        .select("_y", *names)
        .mapInArrow(reduce_partition, f"part int, {RECORD}")
    )

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"part": int(group["part"].iloc[0]) // FAN_IN, **composed(group).record()}])

    while chunks > 1:
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("_next")).applyInPandas(compose, f"part int, {RECORD}")
        chunks = -(-chunks // FAN_IN)
    found = parts.collect()
    return Sweep.of(found[0]) if found else Sweep.empty(size)


def _apply(whole: Sweep, w: np.ndarray) -> tuple[np.ndarray, float]:
    """End weights and mean cost per row of one pass."""
    w, cost = whole.run(w)
    return w, cost / max(1, whole.rows)


def partial_fit(df: DataFrame, columns: Sequence[str], label: str, order: Sequence, eta: float = 0.01,
                weights: Sequence[float] | None = None) -> LinearModel:
    """One pass over the rows in order, going on from ``weights`` (zeros if there are none)."""
    w = np.zeros(len(columns) + 1) if weights is None else np.array(weights, dtype=float)
    w, cost = _apply(sweep_over(df, columns, label, order, eta), w)
    return LinearModel(list(columns), w.tolist(), [cost])


def fit_stochastic(df: DataFrame, columns: Sequence[str], label: str, key: str, eta: float = 0.01,
                   epochs: int = 10, seed: int = 0, shuffle: bool = True) -> LinearModel:
    """Row-by-row descent from zero weights; ``history`` is the mean cost of each epoch.

    With ``shuffle`` every epoch has its own order, drawn from key, seed and
    epoch. Without it the rows stay in key order and one job serves all epochs.
    """
    w = np.zeros(len(columns) + 1)
    history = []
    if not shuffle:
        whole = sweep_over(df, columns, label, [key], eta)
        for _ in range(epochs):
            w, cost = _apply(whole, w)
            history.append(cost)
        return LinearModel(list(columns), w.tolist(), history)
    rows = df.select(key, label, *columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for epoch in range(1, epochs + 1):
            order = [key_digest(key, seed, epoch), F.col(key)]
            place = stable_uniform(key, seed, epoch)
            w, cost = _apply(sweep_over(rows, columns, label, order, eta, place), w)
            history.append(cost)
    finally:
        rows.unpersist()
    return LinearModel(list(columns), w.tolist(), history)
