"""One model per key, wide vectors, and several classes, against plain numpy."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql.types import DoubleType, StructField, StructType

from separatrix.operators import adaline, keyed, newton


def events(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    # One key holds a third of the rows and more.
    return [(i, "hot" if i % 3 == 0 else f"k{i % 7}", float(a), float(b), 1 if a - b + rng.normal() > 0 else -1) for i, (a, b) in enumerate(x)]


def by_row(rows, update, epochs):
    w, figures = np.zeros(3), []
    for _ in range(epochs):
        figures.append(0.0)
        for _, _, a, b, y in rows:
            z = np.array([1.0, a, b])
            u, figure = update(y, z @ w)
            w = w + 0.05 * u * z
            figures[-1] += figure
    return w, figures


def perceptron_step(y, net):
    u = y - (1.0 if net >= 0 else -1.0)
    return u, float(u != 0)


@pytest.mark.parametrize("n,batch", [(600, 17), (75_000, 10_000)])
def test_perceptrons_of_all_keys(spark, n, batch):
    data = events(n)
    holes = [(n, None, 1.0, 1.0, 1), (n + 1, "k1", None, 1.0, 1), (n + 2, "k1", 1.0, 1.0, None), (n + 3, "lost", None, None, None)]
    frame = spark.createDataFrame(data + holes, "id long, k string, a double, b double, y int").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = {r["k"]: r for r in keyed.perceptron_per_key(frame, "k", ["a", "b"], "y", ["id"], 0.05, 2).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(found) == {d[1] for d in data}
    for k in ("hot", "k1"):
        mine = [d for d in data if d[1] == k]
        w, figures = by_row(mine, perceptron_step, 2)
        assert found[k]["n"] == len(mine) and np.allclose(found[k]["w"], w, atol=1e-8) and found[k]["figures"] == figures


def test_descent_of_all_keys_is_shuffled_by_epoch(spark):
    import hashlib

    data = events(300)
    frame = spark.createDataFrame(data, "id long, k string, a double, b double, y int").repartition(3)
    found = {r["k"]: r for r in keyed.stochastic_per_key(frame, "k", ["a", "b"], "y", "id", 0.05, 3, seed=4).collect()}
    mine, w, costs = [d for d in data if d[1] == "hot"], np.zeros(3), []
    for epoch in (1, 2, 3):
        cost = 0.0
        for d in sorted(mine, key=lambda d: hashlib.md5(f"{d[0]}:4:{epoch}".encode()).hexdigest()):
            z = np.array([1.0, d[2], d[3]])
            e = d[4] - z @ w
            w, cost = w + 0.05 * e * z, cost + e * e / 2
        costs.append(cost / len(mine))
    assert np.allclose(found["hot"]["w"], w) and np.allclose(found["hot"]["figures"], costs)
    empty = keyed.perceptron_per_key(frame.filter("false"), "k", ["a", "b"], "y", ["id"])
    assert empty.count() == 0


def test_wide_batch_descent_equals_the_moment_form(spark):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((200, 30)) < 0.3, rng.normal(size=(200, 30)), 0.0)
    y = np.sign(x[:, 0] - x[:, 1] + 0.1)
    names = [f"f{j}" for j in range(30)]
    plain = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"{c} double" for c in names) + ", y double")
    schema = StructType([StructField("v", VectorUDT()), StructField("y", DoubleType())])
    vectors = [(Vectors.sparse(30, [(j, float(a)) for j, a in enumerate(r) if a]) if i % 2 else Vectors.dense(r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    frame = spark.createDataFrame([*vectors, (None, 1.0), (Vectors.dense(x[0]), None)], schema)
    want, got = adaline.fit_batch(plain, names, "y", 1e-3, 12), adaline.fit_batch_vectors(frame, "v", "y", 30, 1e-3, 12)
    assert np.allclose(got.weights, want.weights, atol=1e-12) and np.allclose(got.history, want.history, atol=1e-9)
    with pytest.raises(Exception, match="expected 31"):
        adaline.fit_batch_vectors(frame, "v", "y", 31, 1e-3, 1)


def test_twenty_thousand_columns(spark):
    rng = np.random.default_rng(6)
    rows = [(Vectors.sparse(20_000, sorted((int(j), 1.0) for j in set(rng.integers(0, 20_000, 20)))), float(i % 2 * 2 - 1)) for i in range(300)]
    model = adaline.fit_batch_vectors(spark.createDataFrame(rows, ["v", "y"]), "v", "y", 20_000, 0.01, 3)
    w, costs = np.zeros(20_001), []
    for _ in range(3):
        errors = np.array([y - w[0] - w[v.indices + 1].sum() for v, y in rows])
        costs.append(errors @ errors / 2)
        step = np.zeros(20_001)
        step[0] = errors.sum()
        for (v, _), e in zip(rows, errors):
            step[v.indices + 1] += e
        w = w + 0.01 * step
    assert np.allclose(model.weights, w) and np.allclose(model.history, costs)


@pytest.mark.parametrize("classes", [2, 3])
def test_newton_reaches_the_minimum_of_the_library(spark, classes):
    rng = np.random.default_rng(classes)
    x = rng.normal(size=(300, 2))
    y = (x @ rng.normal(size=(2, classes)) + rng.normal(size=(300, classes))).argmax(1)
    frame = spark.createDataFrame([(float(a), float(b), float(k)) for (a, b), k in zip(x, y)] + [(None, 1.0, 0.0), (1.0, 1.0, None)], "a double, b double, y double")
    model = newton.fit_classes(frame, ["a", "b"], "y", c=2.0)
    assert model.gradient < 1e-6 and np.abs(model.weights.sum(axis=0)).max() < 1e-9
    # The penalty counts each class's weights; the library's regParam is per row.
    library = LogisticRegression(labelCol="y", regParam=1 / (2.0 * 300), standardization=False, family="multinomial", tol=1e-12, maxIter=500)
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(frame.dropna())
    theirs = np.array([r[0] for r in library.fit(rows).transform(rows).select(vector_to_array("probability")).collect()])
    z = np.column_stack([np.ones(300), x])
    p = np.exp(z @ model.weights.T)
    assert np.allclose(p / p.sum(1, keepdims=True), theirs, atol=1e-4)
    said = frame.dropna().withColumn("p", model.predict()).select("p").toPandas()["p"].to_numpy()
    assert (said == p.argmax(1)).all()


def test_newton_without_two_classes(spark):
    one = newton.fit_classes(spark.createDataFrame([(1.0, 4.0)] * 3, "a double, y double"), ["a"], "y")
    assert one.classes == [4.0] and one.weights.tolist() == [[0.0, 0.0]]
    assert newton.fit_classes(spark.createDataFrame([], "a double, y double"), ["a"], "y").classes == []


def test_moments_have_a_limit(spark, monkeypatch):
    frame = spark.createDataFrame([(1.0, 2.0, 1)], "a double, b double, y int")
    monkeypatch.setattr(adaline, "MOMENT_LIMIT", 1)
    with pytest.raises(ValueError, match="exceed 1"):
        adaline.fit_batch(frame, ["a", "b"], "y")
