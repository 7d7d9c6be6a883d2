"""Online learning and scoring on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from separatrix.operators.adaline import BLOCK, RECORD, Sweep, composed, descend, partial_fit
from separatrix.operators.models import LinearModel
from separatrix.storage import parallelism


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stored table as a stream of its files; the path may be a glob."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


class WeightTable:
    """Weights of one global model per micro-batch, one folder for each batch.

    A repeated batch overwrites its own folder and starts from the batch before
    it, so a restart cannot count rows twice.
    """

    schema = "idx int, value double"

    def __init__(self, spark: SparkSession, path: str, size: int):
        self.spark, self.path, self.size = spark, path.rstrip("/"), size

    def _folder(self, batch_id: int) -> str:
        return f"{self.path}/batch_id={batch_id}"

    def before(self, batch_id: int) -> list[float]:
        """Weights that the previous batch left; zeros for the first one."""
        if batch_id == 0:
            return [0.0] * self.size
        rows = self.spark.read.schema(self.schema).parquet(self._folder(batch_id - 1)).collect()
        return [r["value"] for r in sorted(rows, key=lambda r: r["idx"])]

    def write(self, batch_id: int, weights: Sequence[float]) -> None:
        rows = [(j, float(v)) for j, v in enumerate(weights)]
        frame = self.spark.createDataFrame(rows, self.schema).coalesce(1)
        frame.write.mode("overwrite").parquet(self._folder(batch_id))

    def read(self) -> DataFrame:
        """``(batch_id, idx, value)`` of all batches so far."""
        return self.spark.read.schema(f"{self.schema}, batch_id long").parquet(self.path)


def learn_stream(stream: DataFrame, columns: Sequence[str], label: str, order: Sequence[str],
                 eta: float, table: WeightTable, checkpoint: str) -> StreamingQuery:
    """One global online model: each micro-batch is learned row by row in ``order``.

    The rows of a batch are reduced on the executors; only the weights pass
    through the driver.
    """
    def learn(batch: DataFrame, batch_id: int) -> None:
        # The batch is read twice: once to find the ranges of its order, once to learn.
        rows = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            model = partial_fit(rows, columns, label, order, eta, table.before(batch_id))
        finally:
            rows.unpersist()
        table.write(batch_id, model.weights)

    return (
        stream.writeStream.foreachBatch(learn)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class KeyedWeights:
    """Weights of all keys after each micro-batch, one folder for each batch.

    A repeated batch overwrites its own folder and starts from the batch before it.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = f"`{key}` {kind}, seen long, w array<double>"

    def folder(self, batch_id: int) -> str:
        return f"{self.path}/batch_id={batch_id}"

    def after(self, batch_id: int) -> DataFrame:
        """``(key, seen, w)`` that a batch left; no rows before the first one."""
        if batch_id < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.folder(batch_id))

    def read(self) -> DataFrame:
        """``(key, seen, w, batch_id)`` of all batches so far."""
        return self.spark.read.schema(f"{self.schema}, batch_id long").parquet(self.path)


def learn_per_key(stream: DataFrame, key: str, columns: Sequence[str], label: str, order: Sequence[str],
                  eta: float, table: KeyedWeights, checkpoint: str) -> StreamingQuery:
    """One online model per key; each micro-batch is learned row by row in ``order``.

    The rows of a batch are put in the order of key and ``order`` over range partitions,
    which cut a large key in several places. Each stretch of a key becomes one map of the
    weights, and a key's few maps are applied in turn to what the batch before left, so the
    result does not depend on partitions or on the order of arrival within a batch. Late
    rows are applied when they arrive. Rows with a null key, label or feature are left out.
    """
    names, size = list(columns), len(columns) + 1
    kind = stream.schema[key].dataType.simpleString()

    def reduce_partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, current, sweep = TaskContext.get().partitionId(), None, Sweep.empty(size)
        for pdf in frames:
            keys = pdf[key].to_numpy()
            z = np.column_stack([np.ones(len(pdf)), pdf[names].to_numpy(dtype=float)])
            y = pdf["_y"].to_numpy(dtype=float)
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)] if len(keys) else [0]
            for start, end in zip(starts[:-1], starts[1:], strict=True):
                if current is not None and current != keys[start]:
                    yield pd.DataFrame([{key: current, "part": part, **sweep.record()}])
                    sweep = Sweep.empty(size)
                current = keys[start]
                for at in range(start, end, BLOCK):
                    sweep.extend(z[at:min(at + BLOCK, end)], y[at:min(at + BLOCK, end)], eta)
        if sweep.rows:
            yield pd.DataFrame([{key: current, "part": part, **sweep.record()}])

    def go_on(maps: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        held = stored.iloc[0] if len(stored) else None
        seen, w = (int(held["seen"]), np.array(held["w"])) if held is not None else (0, np.zeros(size))
        if len(maps):
            sweep = composed(maps)
            w, _ = sweep.run(w)
            seen += sweep.rows
        whose = (maps if len(maps) else stored)[key].iloc[0]
        return pd.DataFrame({key: [whose], "seen": [seen], "w": [w.tolist()]})

    def learn(batch: DataFrame, batch_id: int) -> None:
        doubles = [F.col(c).cast("double").alias(c) for c in names]
        rows = batch.select(key, *order, F.col(label).cast("double").alias("_y"), *doubles)
        # The batch is read twice: once to find the ranges of its order, once to learn.
        rows = rows.dropna(subset=[key, "_y", *names]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            ranged = rows.repartitionByRange(parallelism(rows), key, *order).sortWithinPartitions(key, *order)
            maps = ranged.select(key, "_y", *names).mapInPandas(reduce_partition, f"`{key}` {kind}, part int, {RECORD}")
            both = maps.groupBy(key).cogroup(table.after(batch_id - 1).groupBy(key))
            both.applyInPandas(go_on, table.schema).write.mode("overwrite").parquet(table.folder(batch_id))
        finally:
            rows.unpersist()

    return (
        stream.writeStream.foreachBatch(learn)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest(table: KeyedWeights) -> DataFrame:
    """``(key, seen, w)`` of every key, from the last batch that wrote it."""
    latest = F.max_by(F.struct("seen", "w"), "batch_id").alias("m")
    return table.read().groupBy(table.key).agg(latest).select(table.key, "m.seen", "m.w")


def learn_keyed_state(stream: DataFrame, key: str, columns: Sequence[str], label: str, order: Sequence[str], eta: float,
                      table: KeyedWeights, checkpoint: str, idle_ms: int | None = None) -> StreamingQuery:
    """One online model per key, its weights in Spark's state store.

    A micro-batch reads and writes the state of its own keys only, and only their weights go
    to ``table``, one folder for each batch; ``newest`` puts them together. State lives in
    RocksDB, outside the heap, and is part of the checkpoint, so a restart goes on where the
    last batch ended. With ``idle_ms`` a key's state goes in the first batch after no row has
    come for so long, and its next row starts from zeros.

    The rows of a key are learned in ``order`` within a batch; late rows are applied when they
    arrive. A task holds a key's rows of one batch as numbers, so the source's limit per
    batch bounds it; ``learn_per_key`` cuts such a key over several tasks instead. Rows with
    a null key, label or feature are left out.
    """
    names, size = list(columns), len(columns) + 1
    kind = stream.schema[key].dataType.simpleString()
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def learn(whose: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, w = state.get if state.exists else (0, [0.0] * size)
        rows = pd.concat(list(frames)).sort_values(list(order), kind="stable")
        z = np.column_stack([np.ones(len(rows)), rows[names].to_numpy(dtype=float)])
        w, _ = descend(z, rows["_y"].to_numpy(dtype=float), np.array(w, dtype=float), eta)
        seen += len(rows)
        state.update((int(seen), w.tolist()))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: [whose[0]], "seen": [seen], "w": [w.tolist()]})

    doubles = [F.col(c).cast("double").alias(c) for c in names]
    rows = stream.select(key, *order, F.col(label).cast("double").alias("_y"), *doubles).dropna(subset=[key, "_y", *names])
    models = rows.groupBy(key).applyInPandasWithState(learn, f"`{key}` {kind}, seen long, w array<double>", "seen long, w array<double>", "update", timeout)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(table.folder(batch_id))

    # A query takes settings along when it starts. Timers would keep it running without new rows.
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    conf = stream.sparkSession.conf
    before = {name: conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        conf.set(name, value)
    try:
        return (
            models.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def score_stream(stream: DataFrame, model: LinearModel) -> DataFrame:
    """Arriving rows with their score and class; stateless."""
    return stream.withColumns({"score": model.score(), "prediction": model.predict()})


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append") -> None:
    """Push everything a source has through a stream into ``sink`` and wait."""
    query = (
        df.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
