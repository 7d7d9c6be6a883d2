"""The classifier on more words than fit a dense vector against the library's."""

import random

import pytest
from pyspark.sql import functions as F

from separatrix.operators import estimators, wide_words


def reviews(spark, n=160):
    rng, words = random.Random(4), [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        y = 1 if rng.random() < 0.6 else -1
        rows.append(([words[min(59, int(rng.paretovariate(0.5)) + 5 * (y == 1))] for _ in range(rng.randrange(25))], y))
    # Rows may repeat; a word with the same count in each row has no variance.
    return spark.createDataFrame([(t + ["same"], y) for t, y in rows + rows[:9]], "t array<string>, y int")


def test_more_words_than_a_dense_vector_holds_have_the_library_s_weights(spark, monkeypatch):
    df = reviews(spark)
    library = estimators.word_logistic(df, "t", "y")
    want = sorted(map(tuple, estimators.word_coefficients(spark, library).collect()))
    scores = estimators.with_outputs(library, df).agg(F.sum("margin"), F.sum("prediction_class"), F.sum("probability_pos")).first()
    monkeypatch.setattr(estimators, "MOST_WORDS", 3)
    monkeypatch.setattr(wide_words, "GROUP_COUNTS", 200)
    model = estimators.all_word_logistic(df, "t", "y")
    assert isinstance(model, wide_words.WideWordModel)
    found = estimators.word_coefficients(spark, model)
    assert found.dtypes == [("idx", "int"), ("name", "string"), ("value", "double")]
    got = sorted(map(tuple, found.collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(got) > 40
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-9)
    assert dict((r[1], r[2]) for r in got)["same"] == 0.0
    mine = model.with_outputs(df, "t").agg(F.sum("margin"), F.sum("prediction_class"), F.sum("probability_pos")).first()
    assert list(mine) == pytest.approx(list(scores), abs=1e-7)


def test_few_words_go_to_the_library_and_one_class_has_no_weights(spark, monkeypatch):
    df = spark.createDataFrame([(["a", "b"], 1), (["a"], 1), (None, 1)], "t array<string>, y int")
    assert estimators.all_word_logistic(reviews(spark, 20), "t", "y").stages[0].vocabulary[0] == "same"
    monkeypatch.setattr(estimators, "MOST_WORDS", 1)
    model = estimators.all_word_logistic(df, "t", "y")
    assert sorted(map(tuple, model.coefficients().collect())) == [(0, "(intercept)", float("inf")), (1, "a", 0.0), (2, "b", 0.0)]
    assert {r["prediction_class"] for r in model.with_outputs(df, "t").collect()} == {1}


def test_the_comparison_of_word_models_is_the_same_beyond_the_dense_limit(spark, monkeypatch):
    from separatrix.plans import inspection

    rows = reviews(spark).withColumnRenamed("y", "sentiment").withColumn("doc_id", F.monotonically_increasing_id())
    rows = rows.withColumn("split", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train")).cache()
    monkeypatch.setattr(inspection.ln, "_tagged_tokens", lambda *_: rows)
    monkeypatch.setattr(inspection.fx, "review_words", lambda *_: ["w1", "w6"])
    want = sorted(map(tuple, inspection.word_model_comparison(spark, "").collect()))
    monkeypatch.setattr(estimators, "MOST_WORDS", 3)
    found = inspection.word_model_comparison(spark, "")
    assert sorted(map(tuple, found.collect())) == want and len(want) == 4
