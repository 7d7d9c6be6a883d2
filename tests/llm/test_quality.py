import random

import numpy as np
import pytest

from llm_docs import docs_of  # noqa: F401
from separatrix.llm import quality

SMALL = quality.Settings(word_bits=8, shape_bits=5, rounds=40)


def corpus(n):
    rng = random.Random(3)
    plain = "the garden was quiet and rain fell on old stones near the mill where children played".split()
    rows = []
    for i in range(n):
        words, good = rng.choices(plain, k=rng.randrange(5, 60)), int(rng.random() < 0.7)
        if not good:
            kind = rng.randrange(3)
            words = [w.upper() for w in words] if kind == 0 else [w + rng.choice(["###", "$$$"]) for w in words] if kind == 1 else words[:1] * 40
        rows.append((i, " ".join(words), good))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame(corpus(600), "doc_id long, text string, quality int").selectExpr("*", "length(text) size")
    return quality.train(rows.drop("quality"), rows.select("doc_id", "quality"), metadata=("size",), settings=SMALL)


def test_pairs_one_by_one():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 30):
        values, vectors = rng.normal(size=n), rng.normal(size=(n, 4))
        plain = sum(values[i] * values[j] * float(vectors[i] @ vectors[j]) for i in range(n) for j in range(i))
        assert quality.pairwise(values, vectors) == pytest.approx(plain)


def test_held_out_rows(spark, model):
    fresh = [(10_000 + i, t, y) for i, t, y in corpus(800)[600:]]
    frame = spark.createDataFrame(fresh, "doc_id long, text string, quality int").selectExpr("*", "length(text) size")
    scores = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.score(frame, model, least=0.3).collect()}
    assert np.mean([scores[i][1] == y for i, _, y in fresh]) > 0.97
    assert all(0 <= s <= 1 and p == (s >= 0.3) for s, p in scores.values())


def test_scores_follow_the_formula(spark, model):
    """The score of a text from its features, every pair of them on its own."""
    text = "the OLD mill### was was was quiet 12\n\nand rain"
    frame = spark.createDataFrame([(1, text, 45)], "doc_id long, text string, size int")
    (row,) = quality.score(frame, model).collect()
    where, values = quality.Features(1, SMALL).of(text, [45.0])
    raw = model.intercept + sum(model.linear[w] * v for w, v in zip(where, values))
    raw += sum(
        values[i] * values[j] * float(model.vectors[where[i]] @ model.vectors[where[j]]) for i in range(len(where)) for j in range(i)
    )
    assert row["score"] == pytest.approx(1 / (1 + np.exp(-raw)))


def test_features():
    features = quality.Features(1, SMALL)
    for text in ("", " \n", "a", "ABC!! ABC!! abc", "é" * 50_000, "x " * 50_000):
        where, values = features.of(text, [None])
        assert len(where) == len(values) == len(set(where.tolist())) and where.min(initial=0) >= 0 and where.max() < features.size
        assert np.isfinite(values).all()
    # A missing number is a class of its own, as is one that is not finite.
    last = [int(features.of("a", [x])[0][-1]) for x in (None, float("nan"), 0.0, 1e300, -1e300)]
    assert last[0] == last[1] and len(set(last)) == 3


def test_awkward_rows(docs_of, model):
    rows = [(1, None), (2, ""), (3, "!!! ???"), (4, "a b " * 50_000), (4, "a b " * 50_000), (None, "rain")]
    frame = docs_of(rows).selectExpr("*", "cast(null as int) size").drop("score")
    got = quality.score(frame, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert quality.score(docs_of([]).selectExpr("*", "1 size"), model).count() == 0


@pytest.mark.parametrize("labels", [[], [0, 0, 0, None, 7], [1, 1]])
def test_labels_of_one_class(spark, docs_of, labels):
    frame = spark.createDataFrame([(i, f"text {i}", y) for i, y in enumerate(labels)], "doc_id long, text string, quality int")
    model = quality.train(frame.drop("quality"), frame.drop("text"), settings=SMALL)
    known = [y for y in labels if y in (0, 1)]
    (row,) = quality.score(docs_of([(1, "a")]), model).collect()
    assert row["score"] == pytest.approx((sum(known) + 1) / (len(known) + 2))
