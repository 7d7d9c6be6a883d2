import random
import re

import numpy as np
import pytest

from llm_docs import docs_of  # noqa: F401
from separatrix.llm import minmax
from separatrix.llm.components import components
from separatrix.llm.scratch import Scratch

CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(CAPITALS))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[i:] for i in range(size))))


def brute_force(rows, size):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = sorted(sets)
    for n, i in enumerate(keys):
        for j in keys[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in keys}


def copies(seed, families, most):
    """Families of texts, each member with some words of the first one replaced."""
    rng = random.Random(seed)
    rows, at = [], 0
    for _ in range(families):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((3, 12, 60, 200)))]
        for _ in range(rng.randrange(1, most)):
            words = list(base)
            for _ in range(rng.randrange(0, max(1, len(words) // 14))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
            rows.append((at, " ".join(words)))
            at += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,block", [(2, 256), (5, 3)])
def test_components_equal_brute_force(docs_of, monkeypatch, size, block):
    # Small blocks make the second round go through several groups.
    monkeypatch.setattr(minmax, "BLOCK", block)
    rows = copies(size, 40, 14)
    rows += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "One"), (9004, "one"), (9005, "É a"), (9006, "é a"), (9007, "b c d"), (9008, rows[3][1] + " "), (9009, "z " * 30_000)]
    want = brute_force(rows, size)
    got = minmax.near_duplicates(docs_of(rows), settings=minmax.Settings(words=size)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len({c for _, c in want.values()}) < len(rows) - 100


def test_missing_keys_repeats_and_no_rows(docs_of):
    settings = minmax.Settings(words=2)
    got = minmax.near_duplicates(docs_of([(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, "A B C")]), settings=settings).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 2, False), (2, 2, True), (4, 2, False), (4, 2, False)]
    assert minmax.near_duplicates(docs_of([]), settings=settings).count() == 0


def test_signatures_estimate_similarity():
    settings = minmax.Settings(permutations=512)
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n, np.uint64) for n in (600, 200, 200))
    signatures = minmax.Signatures(settings)
    x, y = (signatures.of(np.unique(np.concatenate((common, own)))) for own in (a, b))
    assert abs(np.mean(x == y) - 0.6) < 0.05


def test_components_of_long_paths(spark):
    order = list(range(60))
    random.Random(4).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(39)] + [(order[i], order[i + 1]) for i in range(41, 59)] + [(order[40], order[40])]
    found = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark))
    got = {r["node"]: r["component"] for r in found.collect()}
    for part in (order[:40], order[41:]):
        assert {got.get(n, n) for n in part} == {min(part)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_sizes_of_intersections():
    rng = np.random.default_rng(2)
    left, right = ([np.unique(rng.integers(0, 6000, n)) for n in sizes] for sizes in ((5, 4000, 90), (3000, 1, 60, 5000)))
    assert minmax._common(left, right).tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]
    assert minmax._common(left, []).shape == (3, 0) and minmax._common([np.array([1])], [np.array([2])]).tolist() == [[0.0]]


def test_small_sets_miss_no_link(docs_of):
    """Unions of 5 with 4 shared and their like, which bands alone would miss now and then."""
    rng, rows = random.Random(6), []
    for family in range(10_000):
        n = rng.choice((5, 5, 5, 6, 9, 10, 11, 13))
        words = [f"f{family}w{i}" for i in range(n + 1)]
        # One shingle less, one replaced, or two less, whatever is similar enough.
        other = rng.choice([words[:-1], [*words[:-1], "z"], words[:-2] if n >= 10 else words[:-1]])
        if len(set(zip(other, other[1:])) & set(zip(words, words[1:]))) * 100 < 80 * len(set(zip(other, other[1:])) | set(zip(words, words[1:]))):
            other = words[:-1]
        rows += [(2 * family, " ".join(words)), (2 * family + 1, " ".join(other))]
    # Bands of one permutation find next to nothing by themselves here.
    weak = minmax.Settings(words=2, permutations=2)
    got = minmax.near_duplicates(docs_of(rows), settings=weak).filter("doc_id % 2 = 1 and component_id = doc_id - 1")
    assert got.count() == 10_000


def test_which_sets_are_small():
    assert minmax.Settings().small == 13 and minmax.Settings(least=90).small == 28 and minmax.Settings(least=100).small == 0
    rng = np.random.default_rng(3)
    for _ in range(400):
        # Any linked pair of small sets shares a subset's digest.
        n, m = rng.integers(1, 14, 2)
        universe = rng.integers(0, 2**63, 16).astype(np.uint64)
        a, b = (np.unique(rng.choice(universe, k, replace=False)) for k in (n, m))
        if rng.random() < 0.9:
            b = np.unique(np.concatenate((rng.permutation(a)[: max(1, len(a) - rng.integers(0, 3))], rng.choice(universe, rng.integers(0, 3)))))[:13]
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            assert len(np.intersect1d(minmax.subsets(a, minmax.Settings()), minmax.subsets(b, minmax.Settings())))


def test_a_key_with_several_texts(docs_of):
    settings = minmax.Settings(words=2)
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(4, long), (4, "quite another text"), (9, long + " x"), (2, "quite another text"), (None, long), (6, "alone here")]
    got = minmax.near_duplicates(docs_of(rows), settings=settings, carried=("text",)).collect()
    seen = {(r["doc_id"], r["text"]): (r["component_id"], r["kept"]) for r in got}
    assert len(got) == len(rows) and seen == {
        (4, long): (4, True), (4, "quite another text"): (2, False), (9, long + " x"): (4, False), (2, "quite another text"): (2, True),
        (None, long): (4, False), (6, "alone here"): (6, True),
    }
