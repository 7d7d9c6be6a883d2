"""Best split of tree nodes over every distinct value, and small trees grown from it.

Every value of every feature is a candidate. Rows are counted per (node, feature,
value) first, so a common value is one row. Running sums over the values are taken
inside quantile buckets and shifted by the sums of the buckets before, so that no
task needs all values of a feature.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from separatrix.storage import parallelism

# Bucket of null values, after all others.
LAST_BUCKET = 2**31 - 1


def bucketed(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the quantile bucket of every feature as ``{feature}_bucket``."""
    buckets = max(32, parallelism(df))
    probabilities = [n / buckets for n in range(1, buckets)]
    cuts = df.approxQuantile(list(features), probabilities, 0.5 / buckets)
    inner = [sorted(set(c)) or [0.0] for c in cuts]
    model = Bucketizer(
        splitsArray=[[float("-inf"), *c, float("inf")] for c in inner],
        inputCols=list(features),
        outputCols=[f"{f}_bucket" for f in features],
    )
    return model.setHandleInvalid("keep").transform(df)


def _gini(n: Column, positive: Column) -> Column:
    share = positive / n
    return F.lit(2.0) * share * (F.lit(1.0) - share)


def best_splits(df: DataFrame, features: Sequence[str], label: str, node: str) -> DataFrame:
    """``(node, before, impurity, feature, threshold)``: per node the split ``x <= threshold``
    with the lowest weighted Gini impurity, and the impurity without it; ties go to the first feature, then value.
    Null values are on the right of every threshold, as in ``Tree.leaf``.

    ``df`` comes from ``bucketed``."""
    cells = [
        F.struct(
            F.lit(n).alias("feature"),
            F.coalesce(F.col(f"{f}_bucket").cast("int"), F.lit(LAST_BUCKET)).alias("bucket"),
            F.col(f).cast("double").alias("value"),
        )
        for n, f in enumerate(features)
    ]
    counts = (
        df.select(node, (F.col(label) == 1).cast("long").alias("p"), F.inline(F.array(*cells)))
        .groupBy(node, "feature", "bucket", "value")
        .agg(F.count("*").alias("n"), F.sum("p").alias("p"))
    )
    whole = Window.partitionBy(node, "feature")
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        counts.groupBy(node, "feature", "bucket")
        .agg(F.sum("n").alias("bn"), F.sum("p").alias("bp"))
        .select(
            node, "feature", "bucket",
            F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("before_n"),
            F.coalesce(F.sum("bp").over(earlier), F.lit(0)).alias("before_p"),
            F.sum("bn").over(whole).alias("all_n"),
            F.sum("bp").over(whole).alias("all_p"),
        )
    )
    running = (
        Window.partitionBy(node, "feature", "bucket")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    sums = (
        counts.withColumn("run_n", F.sum("n").over(running))
        .withColumn("run_p", F.sum("p").over(running))
        .join(shifts, [node, "feature", "bucket"])
        .select(
            node, "feature", "bucket", "value",
            (F.col("before_n") + F.col("run_n")).cast("double").alias("ln"),
            (F.col("before_p") + F.col("run_p")).cast("double").alias("lp"),
            F.col("all_n").cast("double").alias("n"),
            F.col("all_p").cast("double").alias("p"),
        )
    )
    rn, rp = F.col("n") - F.col("ln"), F.col("p") - F.col("lp")
    impurity = (F.col("ln") * _gini(F.col("ln"), F.col("lp")) + rn * _gini(rn, rp)) / F.col("n")
    before = F.round(_gini(F.col("n"), F.col("p")), 10)
    best = F.min(F.struct(F.round("impurity", 10).alias("impurity"), "feature", "value", "before")).alias("b")
    names = F.array(*[F.lit(f) for f in features])
    return (
        sums.filter((F.col("ln") < F.col("n")) & F.col("value").isNotNull())
        .withColumns({"impurity": impurity, "before": before})
        # The best of a bucket first: its rows are together and sorted already.
        .groupBy(node, "feature", "bucket")
        .agg(best)
        .groupBy(node)
        .agg(F.min("b").alias("b"))
        .select(
            node, "b.before", "b.impurity",
            F.get(names, F.col("b.feature")).alias("feature"),
            F.col("b.value").alias("threshold"),
        )
    )


@dataclass
class Tree:
    """Splits by node: node ``m`` sends ``x <= threshold`` to ``2m``, else to ``2m + 1``."""

    splits: dict[int, tuple[str, float]]

    def leaf(self) -> Column:
        """Number of the leaf a row falls into; the root is 1."""
        return self._below(1)

    def _below(self, node: int) -> Column:
        if node not in self.splits:
            return F.lit(node)
        feature, threshold = self.splits[node]
        return F.when(F.col(feature) <= F.lit(threshold), self._below(2 * node)).otherwise(
            self._below(2 * node + 1)
        )


def grow(df: DataFrame, features: Sequence[str], label: str, max_depth: int) -> Tree:
    """Grow a tree level by level; one job finds the splits of all nodes of a level."""
    tree = Tree({})
    doubles = [F.col(f).cast("double").alias(f) for f in features]
    # Stored before the quantiles are taken, so that the table is made once.
    stored = df.select(label, *doubles).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = bucketed(stored, features)
        for depth in range(max_depth):
            level = rows.withColumn("node", tree.leaf()).filter(F.col("node") >= 2**depth)
            # A node of one class cannot improve: its best split has no lower impurity.
            found = best_splits(level, features, label, "node").filter("impurity < before").collect()
            if not found:
                break
            for r in found:
                tree.splits[r["node"]] = (r["feature"], r["threshold"])
    finally:
        stored.unpersist()
    return tree


def leaves(df: DataFrame, tree: Tree, label: str) -> DataFrame:
    """``(leaf, n, probability)``: every row of a leaf has the leaf's share of +1."""
    return df.groupBy(tree.leaf().alias("leaf")).agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("probability"),
    )
