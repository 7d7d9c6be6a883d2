import json
import math

import pytest
from pyspark.sql import functions as F

from separatrix.functions import vectors as vc
from separatrix.operators import grids, matrix, metrics, ranking, sampling, tables
from separatrix.sources import readers
from separatrix.storage import fresh_path


def test_readers(spark, tmp_path):
    (tmp_path / "iris.data").write_text("5.1,3.5,1.4,0.2,Iris-setosa\n6.2,2.9,4.3,1.3,Iris-versicolor\n")
    rows = readers.read_positional_csv(
        spark, str(tmp_path / "iris.data"), "a double, b double, c double, d double, name string"
    ).collect()
    assert [tuple(r) for r in rows] == [(5.1, 3.5, 1.4, 0.2, "Iris-setosa"), (6.2, 2.9, 4.3, 1.3, "Iris-versicolor")]
    (tmp_path / "words.json").write_text(json.dumps(["baby", "one", "great"], indent=1))
    words = readers.read_word_list(spark, str(tmp_path / "words.json")).orderBy("idx").collect()
    assert [tuple(r) for r in words] == [(0, "baby"), (1, "one"), (2, "great")]


def test_xor_points(spark):
    points = readers.xor_points(spark, 2000).collect()
    assert len(points) == 2000
    assert all(p["label"] == (1 if (p["x0"] > 0) != (p["x1"] > 0) else -1) for p in points)
    assert abs(sum(p["x0"] for p in points) / 2000) < 0.1
    assert readers.xor_points(spark, 50).collect() == readers.xor_points(spark, 50).collect()


def test_order_operators(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(100)], "id long, v double").repartition(5)
    assert [r["id"] for r in tables.row_slice(df, "id", 10, 13).collect()] == [10, 11, 12]
    assert [r["id"] for r in tables.preview(df, "id", 3).collect()] == [0, 1, 2]
    ordered = ranking.sort_desc(df, "v", "id").collect()
    assert [(r["v"], r["id"]) for r in ordered] == sorted(((r["v"], r["id"]) for r in ordered), key=lambda t: (-t[0], t[1]))
    assert [r["id"] for r in ranking.top_k(df, "v", 3, "id").collect()] == [6, 13, 20]
    assert [r["id"] for r in ranking.top_k(df, "v", 3, "id", reverse=True).collect()] == [0, 7, 14]


def test_standardize_on_training_part(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (8.0, 5.0)], "a double, b double")
    scaled = tables.standardize(df, ["a", "b"], fitted_on=df.filter("a < 5"))
    assert [r["a"] for r in scaled.collect()] == [-1.0, 1.0, 6.0]
    assert all(r["b"] is None for r in scaled.collect())


def test_splits_do_not_depend_on_partitioning(spark):
    df = spark.range(5000)
    first = sampling.exact_split(df, "id", 0.3, 0)
    second = sampling.exact_split(df.repartition(17), "id", 0.3, 0)
    assert first.filter("split = 'test'").count() == 1500
    assert first.exceptAll(second).count() == 0
    places = sampling.shuffle_order(df.repartition(3), "id", 1, 2)
    assert sorted(r["position"] for r in places.collect()) == list(range(1, 5001))
    other = {r["id"]: r["position"] for r in sampling.shuffle_order(df, "id", 1, 3).collect()}
    assert any(other[r["id"]] != r["position"] for r in places.collect())
    share = sampling.random_split(df, "id", 0.8, 1).filter("split = 'train'").count() / 5000
    assert abs(share - 0.8) < 0.03


def test_exact_split_edges(spark):
    for n, share, want in ((1, 0.3, 1), (150, 0.3, 45), (7, 1.0, 7), (9, 0.0, 0)):
        tagged = sampling.exact_split(spark.range(n), "id", share, 0)
        assert tagged.filter("split = 'test'").count() == want


@pytest.mark.parametrize("minority", [1, -1])
def test_balance_keeps_the_smaller_class(spark, minority):
    df = spark.range(4000).select("id", F.when(F.col("id") % 5 == 0, minority).otherwise(-minority).alias("y"))
    even = sampling.balance_classes(df, "id", "y", 1)
    counts = {r["y"]: r["n"] for r in metrics.distribution(even, "y").collect()}
    assert counts[minority] == 800
    assert abs(counts[-minority] - 800) < 120


def test_golden_likelihood(spark):
    """X = [[1,2,3],[1,-1,-1]], w = [1,3,-1], y = [-1,1]."""
    df = spark.createDataFrame([(2.0, 3.0, -1), (-1.0, -1.0, 1)], "a double, b double, y int")
    w = [1.0, 3.0, -1.0]
    scored = df.select(vc.affine(["a", "b"], w).alias("s")).withColumn("p", vc.link("s")).collect()
    assert [r["s"] for r in scored] == [4.0, -1.0]
    assert [round(r["p"], 8) for r in scored] == [0.98201379, 0.26894142]
    value = metrics.log_likelihood(df, ["a", "b"], "y", w).first()[0]
    assert round(value, 8) == -5.33141162
    penalized = metrics.log_likelihood(df, ["a", "b"], "y", w, 4.0).first()[0]
    assert penalized == pytest.approx(value - 40.0)
    error = [0 - 0.98201379, 1 - 0.26894142]
    want = [sum(error), 2 * error[0] - error[1] - 24, 3 * error[0] - error[1] + 8]
    got = [r["derivative"] for r in metrics.gradient(df, ["a", "b"], "y", w, 4.0).orderBy("idx").collect()]
    assert got == pytest.approx(want, abs=1e-7)


def test_extreme_scores_do_not_overflow(spark):
    df = spark.createDataFrame([(-2000.0,), (0.0,), (2000.0,)], "s double")
    rows = df.select(
        vc.log1p_exp_neg("s").alias("l"), vc.link("s").alias("p"), vc.sign_inclusive("s").alias("i"), vc.sign_strict("s").alias("t")
    ).collect()
    assert [r["l"] for r in rows] == pytest.approx([2000.0, math.log(2), 0.0])
    assert [r["p"] for r in rows] == [0.0, 0.5, 1.0]
    assert [r["i"] for r in rows] == [-1, 1, 1] and [r["t"] for r in rows] == [-1, -1, 1]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    rows = df.select(
        vc.length("v").alias("l"), vc.normalize("v").alias("u"), vc.signed_distance("v", [0.0, 2.0], 2.0).alias("d"),
        vc.side("v", [1.0, -1.0], 0.0).alias("side"),
    ).collect()
    assert rows[0]["l"] == 5.0 and rows[0]["u"] == [0.6, 0.8] and rows[1]["u"] == [None, None]
    assert [r["d"] for r in rows] == [5.0, 1.0] and [r["side"] for r in rows] == [-1.0, 0.0]
    wide = spark.createDataFrame([([1.0] * 300,)], "v array<double>")
    assert wide.select(vc.dot("v", [0.5] * 300)).first()[0] == 150.0


def test_matrix_product(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.integers(-3, 4, (70, 45)).astype(float), rng.integers(-3, 4, (45, 90)).astype(float)

    def cells(m):
        rows = [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))]
        return spark.createDataFrame(rows, "i long, j long, v double")

    got = np.zeros((70, 90))
    for r in matrix.multiply(cells(a), cells(b), tile=16).collect():
        got[r["i"], r["j"]] = r["v"]
    assert np.array_equal(got, a @ b)


def test_evaluation_figures(spark):
    rows = [(1, 1)] * 5 + [(1, -1)] * 2 + [(-1, 1)] * 3 + [(-1, -1)] * 4
    df = spark.createDataFrame(rows, "y int, p int")
    m = metrics.mistakes(df, "y", "p").first()
    assert (m["true_pos"], m["false_pos"], m["false_neg"], m["correct"], m["total"]) == (5, 3, 2, 9, 14)
    assert m["false_pos"] + m["false_neg"] + m["correct"] == m["total"]
    cost = metrics.mistake_cost(df, "y", "p").first()
    assert cost["total_cost"] == 2 * 10000.0 + 3 * 20000.0
    f = metrics.precision_recall(df, "y", "p").first()
    assert f["precision"] == 5 / 8 and f["recall"] == 5 / 7 and f["correct_over_correct_fn"] == 9 / 11
    none = metrics.precision_recall(df.filter("p = -1 AND y = -1"), "y", "p").first()
    assert none["precision"] is None and none["accuracy"] == 1.0
    assert metrics.accuracy(df, "y", "p").first()["accuracy"] == 9 / 14


def test_area_under_roc_with_a_common_score(spark):
    scores = [(0.5, 1 if i % 4 else -1) for i in range(400)] + [(0.9, 1)] * 50 + [(0.1, -1)] * 30 + [(0.2, 1)] * 5
    df = spark.createDataFrame(scores, "s double, y int")
    pos, neg = [s for s, y in scores if y == 1], [s for s, y in scores if y == -1]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.area_under_roc(df, "y", "s") == pytest.approx(want)


def test_grid(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.1, 0.05)], "a double, b double")
    cells = grids.grid(df, "a", "b", step=0.5).orderBy("cell").collect()
    assert len(cells) == 5 * 5
    assert cells[0]["a"] == -1.0 and cells[1]["a"] == -0.5 and cells[5]["b"] == -0.5


def test_coefficient_columns_are_matched_by_index(spark):
    table = tables.coefficient_words(spark, ["x", "y"])
    shuffled = spark.createDataFrame([(2, 0.2), (0, 0.0), (1, 0.1)], "idx int, value double")
    rows = tables.attach_coefficients(table, shuffled, "w").orderBy("idx").collect()
    assert [(r["word"], r["w"]) for r in rows] == [("(intercept)", 0.0), ("x", 0.1), ("y", 0.2)]


def test_shared_folder_is_the_session_setting(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        assert fresh_path(spark, "x").startswith(folder.rstrip("/"))
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_dot_has_one_contract_for_all_widths(spark):
    for width in (10, 300):
        df = spark.createDataFrame([([1.0] * width,), (None,), ([None] + [1.0] * (width - 1),)], "x array<double>")
        assert [r["d"] for r in df.select(vc.dot("x", [2.0] * width).alias("d")).collect()] == [2.0 * width, None, None]
        for other in (width - 1, width + 1):
            with pytest.raises(Exception, match="vector of length"):
                df.select(vc.dot("x", [2.0] * other)).collect()


def test_product_keeps_cells_that_add_up_to_zero(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 40, 1.0), (1, 0, 2.0)], "i long, j long, v double")
    b = spark.createDataFrame([(0, 0, 1.0), (40, 0, -1.0)], "i long, j long, v double")
    assert sorted(map(tuple, matrix.multiply(a, b).collect())) == [(0, 0, 0.0), (1, 0, 2.0)]


def test_words_are_never_dropped(spark, monkeypatch):
    from separatrix.operators import estimators

    rows = [(["a", "b", "c"], 1), (["a", "d"], -1), (["b"], -1), (["a"], 1)]
    df = spark.createDataFrame(rows, "t array<string>, y int")
    model = estimators.word_logistic(df, "t", "y")
    assert model.stages[0].vocabulary == ["a", "b", "c", "d"]
    monkeypatch.setattr(estimators, "MOST_WORDS", 3)
    with pytest.raises(ValueError, match="more than 3 words"):
        estimators.word_logistic(df, "t", "y")


def test_balance_of_three_classes(spark):
    rows = [(i, 0 if i < 100 else 1 if i < 500 else 2) for i in range(1500)] + [(1500, None)]
    df = spark.createDataFrame(rows, "id long, y int")
    n = {r["y"]: r["count"] for r in sampling.balance_classes(df, "id", "y", 3).groupBy("y").count().collect()}
    assert set(n) == {0, 1, 2} and n[0] == 100 and 70 < n[1] < 135 and 70 < n[2] < 135


def test_splits_count_null_values_on_the_right(spark):
    from separatrix.operators import trees

    # Without the null rows x <= 1 would look perfect; with them, known values against nulls is best.
    rows = [(1.0, -1)] * 4 + [(2.0, 1)] * 4 + [(None, -1)] * 8
    df = spark.createDataFrame(rows, "x double, y int")
    assert trees.grow(df, ["x"], "y", 1).splits == {1: ("x", 2.0)}
    found = trees.best_splits(trees.bucketed(df.withColumn("node", F.lit(1)), ["x"]), ["x"], "y", "node").first()
    assert (found["threshold"], found["impurity"], found["before"]) == (2.0, 0.25, 0.375)


def test_points_of_different_lengths_are_an_error(spark):
    from separatrix.operators import neighbours

    train = spark.createDataFrame([(1, 0, [0.0, 1.0]), (2, 0, None), (3, 1, [5.0, 5.0])], "id long, label long, x array<double>")
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "qid long, x array<double>")
    assert [(r["qid"], r["id"]) for r in neighbours.neighbours(train, queries, 1).collect()] == [(1, 1)]
    ragged = spark.createDataFrame([(1, 0, [0.0, 1.0]), (2, 0, [0.0, 1.0, 2.0, 3.0])], "id long, label long, x array<double>").coalesce(1)
    with pytest.raises(Exception, match="different lengths|inhomogeneous"):
        neighbours.neighbours(ragged, queries, 1).collect()


def test_a_grid_that_one_outlier_stretches_is_an_error(spark, monkeypatch):
    points = spark.createDataFrame([(0.0, 0.0), (1.0, 1e6)], "x double, y double")
    assert grids.grid(points, "x", "y", step=1e4).count() == 101
    monkeypatch.setattr(grids, "MOST_CELLS", 100)
    with pytest.raises(ValueError, match="exceed 100"):
        grids.grid(points, "x", "y", step=1e4)
