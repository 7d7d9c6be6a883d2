import numpy as np
import pytest

from conftest import DATA
from llm_docs import docs_of  # noqa: F401
from separatrix.llm import language_id
from separatrix.llm.queries.language_id import op1_language_id


@pytest.fixture(scope="module")
def model(spark):
    return language_id.train(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_held_out_accuracy(spark):
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = op1_language_id(spark, DATA).filter("held_out").collect()
    assert len(rows) > 30 and np.mean([r["lang_pred"] == known[r["doc_id"]] for r in rows]) >= 0.95


def test_texts_without_letters_and_other_columns(spark, docs_of, model):
    rows = [(1, None), (2, ""), (3, "12 34 !? \n"), (4, "der die das und nicht " * 5000), (4, "der die das und nicht " * 5000), (None, "a")]
    out = language_id.predict(docs_of(rows), model)
    got = sorted(((r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in out.collect()), key=str)
    assert [g[1] for g in got if g[0] in (1, 2, 3)] == ["und"] * 3 and all(0 <= g[2] <= 1 for g in got)
    assert [g[1] for g in got if g[0] == 4] == ["de"] * 2 and len(got) == len(rows) and "class" in out.columns
    assert language_id.predict(docs_of([]), model).count() == 0


def test_shares_of_a_mixed_document(spark, model):
    of = {r["lang"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("n_chars").collect()}
    half = of["en"][:3000] + " " + of["de"][:3000]
    shares, _ = language_id.infer(model, language_id.Grams(model.settings).buckets(half))
    named = {model.languages[c]: s for c, s in shares.items()}
    assert set(named) >= {"en", "de"} and abs(named["en"] - 0.5) < 0.15 and abs(sum(shares.values()) - 1) < 1e-9


def test_proportions_are_the_maximum():
    rng = np.random.default_rng(3)
    rows, counts = rng.dirichlet(np.ones(40), 2).T, rng.integers(1, 20, 40).astype(float)
    shares, value = language_id._proportions(rows, counts, np.array([0.5, 0.5]), language_id.Settings(rounds=500, settled=1e-9))
    grid = max(float(counts @ np.log(rows @ np.array([p, 1 - p]))) for p in np.linspace(0.0005, 0.9995, 2000))
    assert value >= grid - 1e-4 and abs(shares.sum() - 1) < 1e-9


def test_no_rows_to_learn_from(spark, docs_of):
    empty = language_id.train(spark.createDataFrame([(None, "en"), ("x", None)], "text string, lang string"))
    assert empty.languages == ()
    assert [(r["lang_pred"], r["score"]) for r in language_id.predict(docs_of([(1, "word")]), empty).collect()] == [("und", 0.0)]


def test_rows_without_an_id_are_in_no_fold(spark, tmp_path):
    from separatrix.llm.queries.language_id import op1_language_id

    rows = [(None, "rain and stone", "en", "s", 14), (1, "rain and stone", "en", "s", 14), (2, None, None, "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = op1_language_id(spark, str(tmp_path)).collect()
    assert len(got) == 3 and all(isinstance(r["held_out"], bool) for r in got) and [r["held_out"] for r in got if r["doc_id"] is None] == [False]


def test_chosen_languages_are_the_best_of_all_sets():
    """The set that pays most for its penalty, among all sets of four languages."""
    import itertools
    import math

    rng = np.random.default_rng(5)
    settings = language_id.Settings(bits=8, rounds=2000, settled=1e-10)
    likelihood = rng.dirichlet(np.full(256, 0.15), 4) + 1e-6
    likelihood /= likelihood.sum(axis=1, keepdims=True)
    model = language_id.Model(("a", "b", "c", "d"), likelihood, settings)
    for n, mixture in ((40, [1, 0, 0, 0]), (400, [0.5, 0.5, 0, 0]), (400, [0.3, 0, 0.4, 0.3]), (30, [0.9, 0.1, 0, 0]), (2000, [0.25] * 4), (1, [0, 0, 0, 1])):
        buckets = rng.choice(256, n, p=np.array(mixture) @ likelihood)
        counts = np.bincount(buckets, minlength=256)
        at = np.flatnonzero(counts)
        rows, seen = likelihood[:, at].T, counts[at].astype(float)
        cost = settings.penalty * math.log(max(n, 2.0)) / 2
        worth = {}
        for size in range(1, 5):
            for chosen in itertools.combinations(range(4), size):
                _, value = language_id._proportions(rows[:, chosen], seen, np.full(size, 1 / size), settings)
                worth[chosen] = value - cost * (size - 1)
        shares, mean = language_id.infer(model, buckets)
        assert tuple(sorted(shares)) == max(worth, key=worth.get), (n, mixture)
        assert mean * n - cost * (len(shares) - 1) == pytest.approx(max(worth.values()), abs=1e-3)
