import itertools
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from conftest import DATA
from llm_docs import docs_of  # noqa: F401
from separatrix.llm import language_id, packing
from test_minmax import brute_force
from test_secret_scan import expected
from tokenizers import Tokenizer


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        before, rows = rows, docs.collect()
        kept = {r["doc_id"]: r["text"] for r in rows}
        was = {r["doc_id"]: r["text"] for r in before}
        if name == "language_id":
            assert len(kept) == len([t for t in was.values() if re.search(r"[^\W\d_]", t)])
        elif name == "exact_dedup":
            assert set(kept) == {max(i for i, _ in same) for _, same in itertools.groupby(sorted(was.items(), key=lambda p: (p[1], p[0])), lambda p: p[1])}
        elif name == "near_dedup":
            assert set(kept) == {i for i, (_, c) in brute_force(was.items(), 5).items() if i == c}
        else:
            for i, text in was.items():
                out, at = "", 0
                for start, _, kind, end in expected(text):
                    if start >= at:
                        out += text[at:start] + f"[{kind}]"
                    at = max(at, end)
                assert kept[i] == out + text[at:]
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    pieces = packed.drop("ids").collect()
    assert {r["doc_id"] for r in pieces} == set(kept)
    # The sequences hold the redacted texts.
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for i in sorted(kept)[:40]:
        own = sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["piece"])
        ids = [t for r in own for t in whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]]
        assert ids[-1] == 0 and tokenizer.decode(ids[:-1], skip_special_tokens=False) == kept[i]


def test_awkward_documents(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "12 34"), (4, "the rain and the mill and the rain"), (4, "the rain and the mill and the rain"), (5, "the rain and the mill and the rain"),
            (None, "the rain and the mill and the rain"), (6, "the stones token = abcdefgh")]
    docs = docs_of(rows).drop("class", "n").selectExpr("*", "if(doc_id = 3, null, 'en') AS lang", "'s' AS source", "null AS n_chars").selectExpr("*", "1L AS length").drop("n_chars").selectExpr("*", "cast(null AS long) AS n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    got = sorted(r["doc_id"] or 0 for r in docs.collect())
    # Texts without letters go; of equal texts the largest key stays; a row without a key cannot be named and stays.
    assert got == [0, 5, 6]


def test_long_mixtures_and_unlearned_languages_stay(spark, docs_of):
    rng = np.random.default_rng(0)

    def words(letters, n):
        return " ".join("".join(rng.choice(list(letters), rng.integers(3, 8))) for _ in range(n))

    own = {"aa": "abcdef", "bb": "ghijkl", "cc": "mnopqr", "dd": "stuvwx"}
    learned = [(i, words(letters, 400), lang) for i, (lang, letters) in enumerate(own.items())]
    three = " ".join(words(own[lang], 60) for lang in ("aa", "bb", "cc"))
    # Runs of letters as in all four languages in turn, as a language without a label may have them.
    unlearned = " ".join(words(letters, 1) for _ in range(60) for letters in own.values())
    foreign = words("абвгдежз", 120)
    rows = [*learned, (10, three, None), (11, unlearned, None), (12, foreign, None), (13, "12 34 " * 200, None)]
    docs = docs_of([r[:2] for r in rows]).join(spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, lang string"), "doc_id")
    judged = language_id.predict(docs, language_id.train(docs)).filter("doc_id in (10, 11)").collect()
    assert len(judged) == 2 and all(r["score"] < 0.4 and len(r["text"]) >= 500 for r in judged)
    got = corpus_pipeline.language(spark, docs, DATA).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 1, 2, 3, 10, 11, 12]


def test_a_key_with_several_texts_loses_none(spark, docs_of):
    """Only the copy goes, not what else has its id."""
    copied, alone = "the rain and the mill and the rain", "a text that nobody else has here"
    near = " ".join(f"word{i} and" for i in range(60))
    rows = [(4, copied), (4, alone), (9, copied), (5, near), (5, "one more text of its own"), (3, near + " more")]
    docs = docs_of(rows)
    exact = corpus_pipeline.exact(spark, docs, DATA)
    assert sorted((r["doc_id"], r["text"]) for r in exact.collect()) == sorted(r for r in rows if r != (4, copied))
    left = corpus_pipeline.near(spark, exact, DATA)
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == sorted(r for r in rows if r not in ((4, copied), (5, near)))
    assert left.columns == docs.columns
