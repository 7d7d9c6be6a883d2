"""Trees on categories and numbers against all subsets and thresholds."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from separatrix.operators import mixed_trees


def gini(rows):
    share = sum(y == 1 for *_, y in rows) / len(rows) if rows else 0.0
    return len(rows) * 2 * share * (1 - share)


def best(rows):
    """Least weighted impurity over every subset of categories and every threshold."""
    found = []
    for column in (0, 1):
        known = list({r[column] for r in rows})
        for size in range(1, len(known) + 1):
            for left in itertools.combinations(known, size):
                found.append([r for r in rows if r[column] in left])
    found += [[r for r in rows if r[2] is not None and r[2] <= t] for t in {r[2] for r in rows if r[2] is not None}]
    halves = [(part, [r for r in rows if r not in part]) for part in found]
    return min((gini(a) + gini(b) for a, b in halves if a and b), default=None)


def sample(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, x = rng.choice("pqrst") if rng.random() > 0.1 else None, rng.choice(["u", "v", "w"]), rng.randrange(9) if rng.random() > 0.1 else None
        y = 1 if (a in ("q", "s")) + (b == "w") + ((x or 0) > 5) + rng.random() > 1.6 else -1
        rows.append((a, b, float(x) if x is not None else None, i, y))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_each_split_is_the_best_of_all_subsets(spark, seed):
    rows = sample(160, seed)
    frame = spark.createDataFrame(rows, "a string, b string, x double, i int, y int")
    tree = mixed_trees.grow(frame, ["a", "b"], ["x"], "y", 2)
    at = {r["i"]: r["leaf"] for r in frame.select("i", tree.leaf(1).alias("leaf")).collect()}
    below = {r["i"]: r["leaf"] for r in frame.select("i", tree.leaf().alias("leaf")).collect()}
    for depth, want in ((1, at), (None, below)):
        assert {r["i"]: r["leaf"] for r in mixed_trees.with_leaf(frame, tree, depth).collect()} == want
    for node, place in ((1, dict.fromkeys(at, 1)), (2, at), (3, at)):
        mine = [r for r in rows if place[r[3]] == node]
        children = at if node == 1 else below
        least = best(mine)
        if node in tree.splits:
            left = [r for r in mine if children[r[3]] == 2 * node]
            right = [r for r in mine if children[r[3]] == 2 * node + 1]
            assert gini(left) + gini(right) == pytest.approx(least)
        else:
            assert least is None or least >= gini(mine) - 1e-7


def test_categories_decide_alone_and_unknown_ones_go_right(spark):
    rows = [(c, 1.0, 1 if c in "ace" else -1) for c in "abcdef" for _ in range(5)]
    frame = spark.createDataFrame(rows, "c string, x double, y int")
    tree = mixed_trees.grow(frame, ["c"], ["x"], "y", 3)
    assert tree.splits == {1: ("c", ("b", "d", "f"))}
    new = spark.createDataFrame([("b", 1.0), ("zz", 1.0), (None, 1.0)], "c string, x double")
    scored = mixed_trees.with_outputs(new, frame, tree, "y").collect()
    assert sorted((r["c"] or "", r["leaf"], r["probability_pos"], r["prediction_class"]) for r in scored) == [("", 3, 1.0, 1), ("b", 2, 0.0, -1), ("zz", 3, 1.0, 1)]
    # A null is a category: here it goes left.
    holes = spark.createDataFrame([*rows, *[(None, 1.0, -1)] * 3], "c string, x double, y int")
    assert mixed_trees.grow(holes, ["c"], ["x"], "y", 3).splits == {1: ("c", (mixed_trees.NULL, "b", "d", "f"))}


def test_whole_numbers_as_categories_and_limits(spark, monkeypatch):
    frame = spark.createDataFrame([(i % 4, 1 if i % 4 in (1, 3) else -1) for i in range(40)], "g int, y int")
    tree = mixed_trees.grow(frame, ["g"], [], "y", 1)
    assert tree.splits == {1: ("g", ("0", "2"))} and frame.filter(tree.leaf() == 2).select(F.max("g")).first()[0] == 2
    assert mixed_trees.grow(frame.filter("y = 1"), ["g"], [], "y", 2).splits == {}
    monkeypatch.setattr(mixed_trees, "MOST_CATEGORIES", 3)
    with pytest.raises(ValueError, match="categories"):
        mixed_trees.grow(frame, ["g"], [], "y", 1)


def test_a_level_starts_from_the_last_one(spark, monkeypatch):
    sent, real = [], mixed_trees._descended
    monkeypatch.setattr(mixed_trees, "_descended", lambda df, splits, *more: sent.append([n for n, _ in splits]) or real(df, splits, *more))
    frame = spark.createDataFrame(sample(160, 5), "a string, b string, x double, i int, y int")
    tree = mixed_trees.grow(frame, ["a", "b"], ["x"], "y", 3)
    assert sent == [[], [1], sorted(n for n in tree.splits if n in (2, 3))]
    monkeypatch.undo()
    assert {r["leaf"] for r in mixed_trees.with_leaf(frame, tree).collect()} == {r["l"] for r in frame.select(tree.leaf().alias("l")).collect()}
