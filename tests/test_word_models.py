"""Weights as a table against the fit on vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from separatrix.functions.text import with_word_vector
from separatrix.operators import logistic, word_models

WORDS = [f"w{i}" for i in range(30)]


def reviews(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices(WORDS, [30 - j for j in range(30)], k=rng.randrange(0, 40))
        rows.append((i, " ".join(words), 1 if words.count("w3") + rng.random() > words.count("w5") + 0.5 else -1))
    return rows


@pytest.mark.parametrize("broadcast", [True, False])
def test_table_and_vectors_give_the_same_weights(spark, broadcast):
    rows = reviews(200)
    frame = spark.createDataFrame([*rows, (900, None, 1), (901, "w1 w2", None), (None, "w1", 1)], "id long, text string, y int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before if broadcast else -1)
    try:
        model = word_models.fit_words(frame, "id", "text", "y", 1e-3, 6, 2.0)
        found = {r["word"]: r["value"] for r in model.weights.collect()}
        margins = {r["id"]: r["margin"] for r in model.margins(frame.filter("id < 50"), "id", "text").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plain = spark.createDataFrame([*rows, (900, "", 1)], "id long, text string, y int")
    path = logistic.fit_path(with_word_vector(plain, "text", WORDS, lower=True), "features", "y", WORDS, 1e-3, 6, [2.0])
    assert np.allclose([model.intercept, *(found[w] for w in WORDS)], path.weights[0], atol=1e-12)
    want = {i: model.intercept + sum(found[w] for w in t.split()) for i, t, _ in rows[:50]}
    assert margins == pytest.approx(want)
    assert model.coefficients().filter("is_intercept").first()["value"] == model.intercept


def test_more_words_than_a_list_should_hold(spark):
    rows = spark.range(2000).select("id", F.concat_ws(" ", *(F.concat(F.lit("u"), (F.col("id") * 20 + j).cast("string")) for j in range(20)), F.lit("common")).alias("text"),
                                    F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("y"))
    model = word_models.fit_words(rows, "id", "text", "y", 0.1, 2)
    assert model.weights.count() == 40_001
    # Every word of its own has the sign of its row.
    signs = model.weights.filter("word <> 'common'").select((F.floor(F.substring("word", 2, 9).cast("long") / 20) % 2 == 0).alias("even"), F.signum("value").alias("s"))
    assert {tuple(r) for r in signs.distinct().collect()} == {(True, 1.0), (False, -1.0)}
    none = word_models.fit_words(rows.filter("false"), "id", "text", "y", 0.1, 2)
    assert none.intercept == 0.0 and none.weights.count() == 0
