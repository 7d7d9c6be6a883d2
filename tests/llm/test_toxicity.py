import random

import pytest

from llm_docs import docs_of  # noqa: F401
from separatrix.llm import toxicity

SMALL = toxicity.Settings(trees=5, depth=3)


def corpus(n):
    rng = random.Random(3)
    plain = "the garden was quiet and rain fell on old stones near the mill".split()
    rows = []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(5, 40))
        toxic = int(rng.random() < 0.3)
        if toxic:
            # Known words, and words of an unknown stem.
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "zorbul" + rng.choice("abcdefgh") + rng.choice("klmn")]))
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame(corpus(700), "doc_id long, text string, toxic int")
    return toxicity.train(rows.drop("toxic"), rows.drop("text"), settings=SMALL)


def test_held_out_rows(spark, model):
    fresh = [(10_000 + i, t, y) for i, t, y in corpus(900)[700:]]
    frame = spark.createDataFrame(fresh, "doc_id long, text string, toxic int")
    scores = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(frame, model).collect()}
    right = [scores[i][1] == y for i, _, y in fresh]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, p in scores.values())
    assert any(e.startswith("zorb") for e in model.lexicon)


def test_awkward_rows(docs_of, model):
    rows = [(1, None), (2, ""), (3, "!!! ??? 123"), (4, "IDIOT! you 1d10t " * 5000), (4, "IDIOT! you 1d10t " * 5000), (None, "rain")]
    got = toxicity.score(docs_of(rows).drop("score"), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert toxicity.score(docs_of([]), model).count() == 0


def test_features():
    features = toxicity.Features({"zorb-": 3.0}, SMALL)
    got = dict(zip(toxicity.FEATURES, features.of("You IDIOT!! zorbula, 1d10t a b c d e f scum"), strict=True))
    assert got["lexicon"] == 2 / 11 and got["learned"] == 1 / 11 and got["learned_most"] == 3.0
    # The last insult is too far from the second person.
    assert got["second_person"] == 1 / 11 and got["near_second_person"] == 2 / 11 and got["repeated_marks"] == 1 / 11
    assert len(features.of("")) == len(toxicity.FEATURES) and features.of("") == features.of(" ")


@pytest.mark.parametrize("labels", [[], [0, 0, 0, None], [1, 1]])
def test_labels_of_one_class(spark, docs_of, labels):
    frame = spark.createDataFrame([(i, f"text {i}", y) for i, y in enumerate(labels)], "doc_id long, text string, toxic int")
    model = toxicity.train(frame.drop("toxic"), frame.drop("text"), settings=SMALL)
    known = [y for y in labels if y is not None]
    (row,) = toxicity.score(docs_of([(1, "a")]).drop("score"), model).collect()
    assert row["score"] == pytest.approx((sum(known) + 1) / (len(known) + 2))


def test_hidden_spellings():
    features = toxicity.Features({}, SMALL)
    got = dict(zip(toxicity.FEATURES, features.of("1d10t m0r0n plain wrd5 " + "x" * 200_000 + "1"), strict=True))
    assert got["hidden"] == 2 / 5 and got["hidden_hits"] == 2 / 5


def test_scores_follow_trees_and_isotonic_steps(spark, model):
    """Each tree walked by hand, their weighted sum, and the line between isotonic steps."""
    import math

    import numpy as np
    from pyspark.ml.linalg import Vectors

    texts = [t for _, t, _ in corpus(40)] + ["", "IDIOT you 1d10t!!"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(rows, model).collect()}
    features = toxicity.Features(model.lexicon, SMALL)
    steps, values = np.array(model.isotonic.boundaries), np.array(model.isotonic.predictions)
    for i, text in enumerate(texts):
        vector = Vectors.dense(features.of(text))
        margin = sum(w * t.predict(vector) for w, t in zip(model.trees.treeWeights, model.trees.trees))
        raw = 1 / (1 + math.exp(-2 * margin))
        want = 0.999 * float(np.interp(raw, steps, values)) + 0.001 * raw
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_isotonic_calibration_is_the_best_monotone_fit(model):
    import numpy as np

    values = np.array(model.isotonic.predictions)
    assert (np.diff(values) >= 0).all() and 0 <= values.min() and values.max() <= 1
