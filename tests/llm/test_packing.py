import itertools
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import DATA
from llm_docs import docs_of  # noqa: F401
from separatrix.llm import packing
from separatrix.llm.queries.packing import op2_best_fit_packing, packed, vocabulary


def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


def optimum(lengths, capacity):
    """Fewest bins by trying all assignments."""
    best = len(lengths)

    def place(n, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if n == len(lengths):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= lengths[n]:
                place(n + 1, [r - lengths[n] * (i == j) for j, r in enumerate(rooms)])
        place(n + 1, [*rooms, capacity - lengths[n]])

    place(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_optimum_and_best_fit(lengths):
    bins, offsets, count = packing.best_fit_decreasing(np.array(lengths), 20)
    bound = packing.lower_bound(np.bincount(lengths, minlength=21), 20)
    assert bound <= optimum(sorted(lengths, reverse=True), 20) <= count
    for b in range(count):
        own = sorted((o, n) for o, n, where in zip(offsets, lengths, bins) if where == b)
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own[:-1])] and sum(n for _, n in own) <= 20


def test_bound_beats_the_sum_of_lengths():
    # Three pieces just above half need three sequences, two thirds of them pair up with nothing.
    assert packing.lower_bound(np.bincount([11, 11, 11], minlength=21), 20) == 3
    assert packing.lower_bound(np.bincount([7] * 6, minlength=21), 20) == 3


def test_cutting():
    assert packing.cut(1, 8) == [(0, 1)] and packing.cut(8, 8) == [(0, 8)] and packing.cut(9, 8) == [(0, 1), (1, 8)]
    assert packing.cut(24, 8) == [(0, 8), (8, 8), (16, 8)] and packing.cut(20, 8) == [(0, 4), (4, 8), (12, 8)]


def check(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts[:-1])] and sum(n for _, n in parts) <= capacity
    return len(by_sequence)


def test_exchange_between_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 0, int(n), "p", 1) for i, n in enumerate(rng.integers(5, 64, 600))]
    frame = spark.createDataFrame(rows, "doc_id long, piece int, length long, part string, offset int")
    packed = packing.pack(frame, capacity=64, per_part=40, exchanges=6)
    got = packed.collect()
    alone = packing.pack(frame, capacity=64, per_part=40, exchanges=0).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == sorted((i, n) for i, _, n, *_ in rows)
    used, bound = packing.bounds(packed, 64)
    assert bound <= check(got, 64) == used <= check(alone, 64)
    assert packed.columns == ["doc_id", "piece", "length", "part", "sequence_id", "offset", "group_sequences", "group_bound"]
    assert all(r["group_bound"] <= r["group_sequences"] for r in got)
    assert packing.pack(frame.limit(0), capacity=64).count() == 0


def test_pieces_and_sequences(docs_of):
    texts = {1: None, 2: "", 3: "Was it <|endoftext|> here? ", 4: "der Hund läuft, it's 日本 " * 900, 5: "x" * 5000, 6: "a"}
    rows = [*texts.items(), (6, "a")]
    cut_up = packing.pieces(docs_of(rows), vocabulary(), public_tokenizers.PATTERN)
    tokenizer = library()
    want = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    got = cut_up.collect()
    for i in texts:
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]) for r in got if r["doc_id"] == i)
        assert len(own) == (2 if i == 6 else -(-len(want[i]) // 2048))
        for _, start, length, crc, ids in own:
            part = want[i][start : start + length]
            assert ids == part.tolist() and crc == zlib.crc32(part.tobytes())
    packed = packing.pack(cut_up)
    whole = packing.sequences(packed).collect()
    assert check(packed.collect(), 2048) == len(whole) == -(-sum(len(want[i]) for i, _ in rows) // 2048)
    assert sum(len(r["ids"]) for r in whole) == sum(len(want[i]) for i, _ in rows)
    assert packing.pieces(docs_of([]), vocabulary(), public_tokenizers.PATTERN).count() == 0


def test_query_is_as_good_as_the_bound(spark):
    packed = op2_best_fit_packing(spark, DATA)
    used, bound = packing.bounds(packed)
    assert check(packed.collect(), 2048) == used and used <= bound + 1
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    lengths = {r["doc_id"]: len(library().encode(r["text"], add_special_tokens=False).ids) + 1 for r in texts[:40]}
    found = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert len(found) == len(texts) and all(found[i] == n for i, n in lengths.items())


def test_vocabulary_without_single_bytes_is_an_error():
    with pytest.raises(ValueError, match="single bytes"):
        packing.Tokenizer(b'{"model": {"vocab": {"a": 0}, "merges": []}}', public_tokenizers.PATTERN)


def test_added_tokens_have_their_own_ids_as_in_the_library(docs_of):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = dict(enumerate([f"a {mark} b", mark, mark * 3, f"x  {mark}  y", f"{mark}\n\n 12", f"<{mark}>", "<|endoftext|", f"it's {mark}'s", f"{mark} läuft 日本 " * 700]))
    for i, text in texts.items():
        own = packing.Tokenizer(vocabulary(), public_tokenizers.PATTERN, encode_special_tokens=False).encode(text)
        assert own.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, i
    want = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    got = packed(docs_of(list(texts.items()))).collect()
    assert sum(r["length"] for r in got) == sum(map(len, want.values()))
    for r in got:
        part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(part.tobytes())


@pytest.mark.parametrize("added", [[{"id": 9, "content": "<x>", "lstrip": True}], [{"id": 8, "content": "<x"}, {"id": 9, "content": "<x>"}]])
def test_added_tokens_that_tiktoken_cannot_find_are_an_error(added):
    file = json.dumps(json.loads(vocabulary()) | {"added_tokens": added}).encode()
    with pytest.raises(ValueError, match="added tokens"):
        packing.Tokenizer(file, public_tokenizers.PATTERN, encode_special_tokens=False)


def test_keys_stay_next_to_missing_ones(spark):
    """Ids that no double holds, in a group with a row that has none."""
    large = 2**53
    rows = [(large + 1, 0, 5), (large + 3, 0, 7), (None, 0, 6), (-large - 5, 1, 3), (None, 0, 64)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long"), capacity=64).collect()
    assert sorted(map(repr, ((r["doc_id"], r["piece"], r["length"]) for r in got))) == sorted(map(repr, rows))
    assert check(got, 64) == 2


def test_squeezed_ids_come_back():
    rng = np.random.default_rng(2)
    for ids in ([], [0], [50_256, 0, 2**32 - 1], rng.integers(0, 50_257, 2048).tolist()):
        array = np.array(ids, np.uint32)
        assert packing.restored(packing.squeezed(array), len(array)).tolist() == ids


def test_sequences_of_the_query_decode_to_the_texts(docs_of):
    texts = {1: None, 2: "", 3: "Was it <|endoftext|> here? ", 4: "der Hund läuft, it's 日本 " * 900, 5: "x" * 5000, 6: "a"}
    rows = packed(docs_of(list(texts.items())))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(rows).collect()}
    pieces = rows.collect()
    assert sum(map(len, whole.values())) == sum(r["length"] for r in pieces)
    for i, text in texts.items():
        ids = []
        for r in sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["piece"]):
            part = whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            ids += part
        assert ids == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert tokenizer.decode(ids[:-1], skip_special_tokens=False) == (text or "")
