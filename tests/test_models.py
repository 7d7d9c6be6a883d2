import numpy as np
import pytest
from pyspark.sql import functions as F

from separatrix.operators import estimators, metrics, neighbours, trees
from separatrix.plans import fixtures as fx
from separatrix.plans import learning as ln
from separatrix.sources.readers import xor_points
from conftest import DATA


def brute(points, queries, k):
    found = {}
    for qid, q in queries:
        near = sorted((float(np.sqrt(((np.array(p) - np.array(q)) ** 2).sum())), i) for i, p, _ in points)
        found[qid] = [i for _, i in near[:k]]
    return found


def knn_ids(spark, points, queries, k):
    train = spark.createDataFrame(points, "id long, x array<double>, label int")
    ask = spark.createDataFrame(queries, "qid long, x array<double>")
    rows = neighbours.neighbours(train, ask, k).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r["qid"], r["rank"])):
        found.setdefault(r["qid"], []).append(r["id"])
    return found


@pytest.mark.parametrize("dims,group_rows", [(2, 50_000), (2, 40), (8, 40)])
def test_neighbours_equal_brute_force(spark, monkeypatch, dims, group_rows):
    monkeypatch.setattr(neighbours, "GROUP_ROWS", group_rows)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, dims))
    x[:100] = x[0]  # one place holds a third of all points
    points = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    queries = [(1000 + i, v.tolist()) for i, v in enumerate(np.vstack([x[:120], 3 * rng.normal(size=(60, dims))]))]
    assert knn_ids(spark, points, queries, 3) == brute(points, queries, 3)


def test_fewer_points_than_neighbours(spark):
    points = [(1, [0.0], 1), (2, [5.0], -1)]
    assert knn_ids(spark, points, [(9, [1.0])], 3) == {9: [1, 2]}


def test_vote_ties_go_to_the_smaller_label(spark):
    rows = [(1, 5), (1, 3), (2, 4), (2, 4), (2, 1)]
    won = neighbours.vote(spark.createDataFrame(rows, "qid long, label long"))
    assert {r["qid"]: r["prediction"] for r in won.collect()} == {1: 3, 2: 4}


def best_by_hand(x, y):
    def gini(v):
        p = np.mean(v == 1)
        return 2 * p * (1 - p)

    best = None
    for j in range(x.shape[1]):
        for t in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= t
            value = round((left.sum() * gini(y[left]) + (~left).sum() * gini(y[~left])) / len(y), 10)
            if best is None or (value, j, t) < best:
                best = (value, j, t)
    return best


def test_best_split_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=600), rng.integers(0, 9, 600)])
    x[:200, 0] = 0.25  # a common value
    y = np.where(x[:, 0] + 0.2 * x[:, 1] + rng.normal(size=600) > 1.0, 1, -1)
    df = spark.createDataFrame([(*map(float, v), int(t)) for v, t in zip(x, y)], "a double, b double, y int")
    row = trees.best_splits(
        trees.bucketed(df, ["a", "b"]).withColumn("node", F.lit(1)), ["a", "b"], "y", "node"
    ).first()
    value, j, t = best_by_hand(x, y)
    assert (row["feature"], row["threshold"]) == ("ab"[j], t) and row["impurity"] == pytest.approx(value)


def test_tree_stops_at_pure_nodes_and_leaves_share_a_probability(spark):
    df = spark.createDataFrame([(float(i), 1 if i < 30 else -1) for i in range(100)], "a double, y int")
    tree = trees.grow(df, ["a"], "y", 3)
    assert tree.splits == {1: ("a", 29.0)}
    found = {r["leaf"]: (r["n"], r["probability"]) for r in trees.leaves(df, tree, "y").collect()}
    assert found == {2: (30, 1.0), 3: (70, 0.0)}


def test_library_outputs_equal_hand_predictions(spark):
    rows = ln._tagged_tokens(spark, DATA)
    words = fx.review_words(spark, DATA)
    model = estimators.word_logistic(rows, "t", "sentiment", words)
    scored = estimators.with_outputs(model, rows)
    assert scored.filter((F.col("margin") > 0) != (F.col("prediction_class") == 1)).count() == 0
    off = F.abs(F.col("probability_pos") - 1 / (1 + F.exp(-F.col("margin"))))
    assert scored.agg(F.max(off)).first()[0] < 1e-12
    table = estimators.word_coefficients(spark, model)
    assert table.count() == len(words) + 1 and table.filter("idx = 0").first()["name"] == "(intercept)"


def test_deeper_trees_fit_the_training_rows_better(spark):
    rows = fx.balanced_loans(spark, "/root/testdata/sf0.01")
    got = []
    for depth in (2, 6, 10):
        model = estimators.decision_tree(rows, ln.CATEGORICAL, ln.NUMERIC, "safe_loans", depth)
        scored = estimators.with_outputs(model, rows)
        got.append(metrics.accuracy(scored, "safe_loans", "prediction_class").first()["accuracy"])
        wrong = scored.filter((F.col("probability_pos") > 0.5) != (F.col("prediction_class") == 1))
        assert wrong.filter("probability_pos <> 0.5").count() == 0
    assert got[0] < got[1] < got[2]


def test_tree_accepts_unseen_categories(spark):
    train = spark.createDataFrame([("u", 1.0, 1), ("v", 2.0, -1)] * 20, "c string, v double, y int")
    model = estimators.decision_tree(train, ["c"], ["v"], "y", 2)
    assert model.transform(spark.createDataFrame([("new", 1.0)], "c string, v double")).count() == 1


def test_kernel_machine_solves_xor(spark):
    points = xor_points(spark, 400).withColumn("target", estimators.binary_label("label")).cache()
    model, mapped = estimators.rbf_svm(points, ["x0", "x1"], "target", gamma=0.5, width=80, max_iter=30)
    scored = model.transform(mapped(points))
    assert metrics.accuracy(scored, "target", "prediction").first()["accuracy"] > 0.9
    line = estimators.linear_svm(points, ["x0", "x1"], "target", max_iter=20).transform(points)
    assert metrics.accuracy(line, "target", "prediction").first()["accuracy"] < 0.75


def test_queries_go_to_regions_once_and_not_to_each_cell(spark):
    pivots = np.arange(40.0)[:, None]
    sizes = np.full(40, 10)
    region = neighbours._regions(pivots, sizes, 100)
    assert np.bincount(region, weights=sizes).max() <= 100 and len(set(region)) == 4
    assert (np.diff(region) >= 0).all() or (np.diff(region) <= 0).all()
    rows = [(1, [0.0], list(range(40))), (2, [5.0], [4, 5, 6])]
    sent = neighbours._sent(spark.createDataFrame(rows, "qid long, x array<double>, cells array<int>"), region, sizes).collect()
    # None of the cells stands for all of them.
    assert sorted((r["qid"], r["region"]) for r in sent if not r["cells"]) == [(1, n) for n in range(4)]
    assert [r["cells"] for r in sent if r["qid"] == 2] == [[4, 5, 6]]


def test_memory_of_a_group_of_points_is_bounded():
    import tracemalloc

    import pyarrow as pa

    rng, n = np.random.default_rng(1), 3000
    x = pa.array(list(rng.random((n, 2))), pa.list_(pa.float64()))
    train = pa.table({"id": pa.array(range(n)), "label": pa.array([0] * n), "cell": pa.array([0] * n, pa.int32()), "x": x})
    queries = pa.table({"qid": pa.array(range(n)), "x": x, "cells": pa.array([[]] * n, pa.list_(pa.int32()))})
    tracemalloc.start()
    found = neighbours._nearest(train, queries, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 2 * n and peak < 60_000_000
