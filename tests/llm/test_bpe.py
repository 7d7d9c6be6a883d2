import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from llm_docs import docs_of  # noqa: F401
from separatrix.llm import bpe
from separatrix.llm.queries.bpe import VOCABULARY

RANKS = bpe.read_ranks(VOCABULARY)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
random.seed(5)
TEXTS = ["", None, "a" * 3000, " 日本語" * 200, "zq" * 500, "😀ßä€" * 90, "<|endoftext|> it's", "\x00\ud7ff \t\n  x", "".join(random.choices("etaoin shrdlu", k=4000)),
         "".join(random.choices("abcdefghijklmnop", k=1500)), "Was ist das? " * 2000]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, public_tokenizers.PATTERN)


def test_same_ids_as_the_library_and_back(docs_of):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "word")]
    ids = bpe.encode(docs_of(rows), RANKS, public_tokenizers.PATTERN)
    got = bpe.decode(ids.selectExpr("doc_id", "ids", "ids AS key"), RANKS).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "word" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        assert r["key"] == LIBRARY.encode_ordinary(text) and bytes(r["decoded"]) == text.encode(), r["doc_id"]
    assert bpe.encode(docs_of([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_every_token_encodes_to_itself(encoder):
    # What batch contraction in long words rests on; without the shortcut for whole tokens.
    tokens = [t for t in RANKS if 2 <= len(t) <= bpe.SHORT]
    assert all(len(ids) == 1 and ids[0] == RANKS[t] for t, ids in zip(tokens, encoder.contract(tokens), strict=True))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300))
def test_any_text(encoder, text):
    assert encoder.encode([text])[0].as_py() == LIBRARY.encode_ordinary(text)


def test_both_forms_agree(encoder):
    words = ["".join(random.choices("abrth", k=n)).encode() for n in range(2, 60)]
    for short, long in zip(encoder.contract(words), encoder.contract_long(words), strict=True):
        assert short.tolist() == long.tolist()


def test_null_lists_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [RANKS[b"a"]])], "n int, ids array<int>")
    assert {r["n"]: bytes(r["decoded"]) for r in bpe.decode(rows, RANKS).collect()} == {1: b"", 2: b"", 3: b"a"}
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [-5])], "n int, ids array<int>"), RANKS).collect()
