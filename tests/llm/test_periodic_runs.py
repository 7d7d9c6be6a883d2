import random

import numpy as np
import pytest

from llm_docs import docs_of  # noqa: F401
from separatrix.llm import periodic_runs
from separatrix.llm.periodic_runs import Settings, collapsed, find_runs


def every_lag(words, settings):
    """Runs by comparing the words with themselves at every lag; the smallest period of a stretch comes first."""
    n, found = len(words), {}
    for q in range(1, n // settings.times + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i > s and i - s + q >= max(settings.least, settings.times * q):
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in found.items())


def random_words(rng):
    letters, words = rng.choice([1, 2, 3, 50]), []
    while len(words) < rng.choice([10, 60, 200, 400]):
        block = [rng.randrange(letters) for _ in range(rng.randrange(1, 40))]
        words += (block * 9)[: int(len(block) * rng.uniform(1, 6))] if rng.random() < 0.6 else block
        if rng.random() < 0.3:
            # A passage from before, as seeds of other lags.
            s = rng.randrange(len(words))
            words += words[s : s + 60]
    return np.array(words)


@pytest.mark.parametrize("settings", [Settings(), Settings(6, 2), Settings(5, 3), Settings(1, 2), Settings(40, 4)])
def test_all_lags(settings):
    rng = random.Random(repr(settings))
    for _ in range(200):
        words = random_words(rng)
        assert find_runs(words, settings) == every_lag(words.tolist(), settings)


def test_equal_hashes_of_different_words():
    words = random_words(random.Random(5))
    assert find_runs(words, Settings(), np.zeros(len(words), np.int64)) == every_lag(words.tolist(), Settings())


@pytest.mark.parametrize("least", [23, 24])
def test_shortest_runs(least):
    # Period 8: 24 words are three periods. Without the last word there is no run.
    words = np.array([*range(100, 110), *(list(range(8)) * 3)[:least], *range(200, 210)])
    assert find_runs(words) == ([(10, 24, 8)] if least == 24 else [])


def test_long_texts_stay_cheap():
    n = 100_000
    spread = (np.arange(n) % 1001 == 0).astype(np.int64)
    runs = find_runs(spread)
    assert (0, n, 1001) in runs and all(q == 1 for s, length, q in runs if length < n)
    assert find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert find_runs(np.arange(n)) == []


def test_rows(docs_of):
    again = "x y z " * 8
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b " * 30), (5, "u " + again + "v"), (5, "u " + again + "v"), (None, again), (6, "Ab " * 23)]
    got = periodic_runs.periodic_runs(docs_of(rows)).collect()
    seen = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=repr)
    assert seen == sorted(
        [
            (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 30, [(0, 30, 1)], "a b"), (6, 23, [], " ".join(["Ab"] * 23)),
            *[(5, 26, [(1, 24, 3)], "u x y z v")] * 2, (0, 24, [(0, 24, 3)], "x y z"),
        ],
        key=repr,
    )
    assert periodic_runs.periodic_runs(docs_of([])).count() == 0


def test_overlapping_runs_collapse_once():
    words = [b"a"] * 24 + [b"b"] + [b"a"] * 24
    runs = find_runs(np.array([w == b"a" for w in words], np.int64))
    assert runs == [(0, 24, 1), (25, 24, 1)] and collapsed(words, runs) == "a b a"
