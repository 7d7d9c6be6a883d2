"""Decision trees on numeric and categorical columns, every split exact.

A numeric split is ``x <= threshold``, over every distinct value. A categorical split sends
some categories left: ordered by their share of positive rows, the best subset for two
classes is the first few of them (Breiman et al. 1984), so a node has as many candidates as
categories and not as many as subsets. All nodes of a level are found together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from separatrix.operators.trees import _gini, best_splits, bucketed

# Categories of a column, which a split lists.
MOST_CATEGORIES = 10_000
# What stands for a null among the categories.
NULL = "\x00"


def _category(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NULL))


@dataclass
class MixedTree:
    """Splits by node: ``(feature, threshold)``, or ``(feature, categories)`` of those that go left.

    Node ``m`` has the children ``2m`` and ``2m + 1``. A null is a category like others; null
    numbers and unknown categories go right.
    """

    splits: dict[int, tuple[str, float | tuple[str, ...]]]

    def goes_left(self, node: int) -> Column:
        feature, where = self.splits[node]
        column = F.col(feature)
        return _category(feature).isin(list(where)) if isinstance(where, tuple) else column <= F.lit(where)

    def leaf(self, depth: int | None = None) -> Column:
        """Number of the leaf a row falls into; the root is 1. ``depth`` cuts the tree off there.

        One expression for all nodes, so for small trees; ``with_leaf`` takes any.
        """
        return self._below(1, depth)

    def _below(self, node: int, depth: int | None) -> Column:
        if node not in self.splits or depth is not None and node >= 2**depth:
            return F.lit(node)
        return F.when(self.goes_left(node), self._below(2 * node, depth)).otherwise(self._below(2 * node + 1, depth))


def with_leaf(df: DataFrame, tree: MixedTree, depth: int | None = None, name: str = "leaf") -> DataFrame:
    """``df`` with the number of the leaf of each row.

    The tree goes to the tasks as it is: an expression with hundreds of branches would not
    be compiled any more.
    """
    splits = sorted((n, s) for n, s in tree.splits.items() if depth is None or n < 2**depth)
    return _descended(df, splits, name)


def _descended(df: DataFrame, splits: Sequence[tuple], name: str, begun: bool = False) -> DataFrame:
    """``df`` with the node of each row below ``splits``, from the root or the node it has ``begun`` with."""
    columns = sorted({(f, isinstance(where, tuple)) for _, (f, where) in splits})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, held = batch.column(name).to_numpy().copy() if begun else np.ones(batch.num_rows, np.int32), {}
            for f, categorical in columns:
                column = batch.column(f)
                held[f] = pc.fill_null(column.cast(pa.string()), NULL) if categorical else column.cast(pa.float64()).to_numpy(zero_copy_only=False)
            # Parents have smaller numbers than their children.
            for node, (f, where) in splits:
                here = np.flatnonzero(leaf == node)
                if not len(here):
                    continue
                if isinstance(where, tuple):
                    left = pc.is_in(held[f].take(pa.array(here)), value_set=pa.array(where, pa.string())).to_numpy(zero_copy_only=False)
                else:
                    # Nulls are not a number here, and that is not below anything.
                    left = held[f][here] <= where
                leaf[here] = np.where(left, 2 * node, 2 * node + 1)
            same = batch.num_columns - begun
            yield pa.RecordBatch.from_arrays([*batch.columns[:same], pa.array(leaf)], [*batch.schema.names[:same], name])

    # A node begun with is the last column.
    same = df.schema.fields[:-1] if begun else df.schema.fields
    return df.mapInArrow(work, StructType([*same, StructField(name, IntegerType())]))


def _category_splits(level: DataFrame, categorical: Sequence[str], label: str) -> DataFrame:
    """``(node, before, impurity, feature, place, left)``: the best subset of each node and column."""
    cells = [F.struct(F.lit(c).alias("feature"), _category(c).alias("category")) for c in categorical]
    counts = (
        level.select("node", (F.col(label) == 1).cast("long").alias("p"), F.inline(F.array(*cells)))
        .groupBy("node", "feature", "category").agg(F.count("*").alias("n"), F.sum("p").alias("p"))
    )
    whole = Window.partitionBy("node", "feature")
    order = whole.orderBy(F.col("p") / F.col("n"), "category")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.select(
        "node", "feature", "category", F.row_number().over(order).alias("place"),
        F.sum("n").over(run).cast("double").alias("ln"), F.sum("p").over(run).cast("double").alias("lp"),
        F.sum("n").over(whole).cast("double").alias("n"), F.sum("p").over(whole).cast("double").alias("p"),
    )
    rn, rp = F.col("n") - F.col("ln"), F.col("p") - F.col("lp")
    impurity = F.when(
        F.col("ln") < F.col("n"),
        F.round((F.col("ln") * _gini(F.col("ln"), F.col("lp")) + rn * _gini(rn, rp)) / F.col("n"), 10),
    )
    judged = sums.withColumns({"impurity": impurity, "before": F.round(_gini(F.col("n"), F.col("p")), 10)})
    best = judged.groupBy("node", "feature").agg(
        F.min(F.when(F.col("impurity").isNotNull(), F.struct("impurity", "place"))).alias("b"), F.first("before").alias("before"),
        F.collect_list(F.struct("place", "category")).alias("all"),
    )
    left = F.transform(F.filter("all", lambda c: c["place"] <= F.col("b.place")), lambda c: c["category"])
    return best.filter("b is not null").select("node", "before", "b.impurity", "feature", "b.place", left.alias("left"))


def grow(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], label: str, max_depth: int) -> MixedTree:
    """Grow level by level; a node splits if that lowers its Gini impurity (to 10 digits).

    Equal impurities go to the column that is listed first, categorical ones before numeric
    ones, then to the smaller threshold or subset. A column of more than ``MOST_CATEGORIES``
    categories is an error.
    """
    tree, levels = MixedTree({}), []
    doubles = [F.col(c).cast("double").alias(c) for c in numeric]
    stored = df.select(label, *(F.col(c).cast("string").alias(c) for c in categorical), *doubles).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if categorical:
            sizes = stored.agg(*(F.approx_count_distinct(c).alias(c) for c in categorical)).first()
            if max(sizes) > MOST_CATEGORIES:
                raise ValueError(f"more than {MOST_CATEGORIES} categories: {sizes.asDict()}")
        rows = bucketed(stored, list(numeric)) if numeric else stored
        order = {c: n for n, c in enumerate([*categorical, *numeric])}
        for depth in range(max_depth):
            # One level down from the rows of the last one: what did not split there is done.
            last = [(n, s) for n, s in sorted(tree.splits.items()) if n >= 2 ** (depth - 1)]
            level = _descended(rows, last, "node", depth > 0).filter(F.col("node") >= 2**depth).persist(StorageLevel.MEMORY_AND_DISK)
            levels.append(level)
            kinds = []
            if categorical:
                splits = _category_splits(level, categorical, label)
                kinds.append(splits.select("node", "before", "impurity", "feature", F.lit(None).cast("double").alias("threshold"), "left"))
            if numeric:
                splits = best_splits(level, list(numeric), label, "node")
                kinds.append(splits.select("node", "before", "impurity", "feature", "threshold", F.lit(None).cast("array<string>").alias("left")))
            # One job for all nodes and columns of a level.
            found = reduce(DataFrame.union, kinds).filter("impurity < before").collect()
            if len(levels) > 1:
                levels.pop(0).unpersist()
            rows = level
            if not found:
                break
            for r in sorted(found, key=lambda r: (r["impurity"], order[r["feature"]]), reverse=True):
                tree.splits[r["node"]] = (r["feature"], r["threshold"] if r["left"] is None else tuple(sorted(r["left"])))
    finally:
        for kept in [*levels, stored]:
            kept.unpersist()
    return tree


def leaf_shares(df: DataFrame, tree: MixedTree, label: str, depth: int | None = None) -> DataFrame:
    """``(leaf, probability_pos)``: the share of positive rows; a node that no row reaches has none."""
    positive = F.avg(F.when(F.col(label) == 1, 1.0).otherwise(0.0))
    return with_leaf(df, tree, depth).groupBy("leaf").agg(positive.alias("probability_pos"))


def with_outputs(df: DataFrame, train: DataFrame, tree: MixedTree, label: str, depth: int | None = None) -> DataFrame:
    """Add ``leaf``, ``probability_pos`` and ``prediction_class`` (+1 above one half); the tree has few leaves."""
    shares = leaf_shares(train, tree, label, depth)
    scored = with_leaf(df, tree, depth).join(shares, "leaf", "left")
    return scored.withColumn("prediction_class", F.when(F.col("probability_pos") > 0.5, 1).otherwise(-1))
