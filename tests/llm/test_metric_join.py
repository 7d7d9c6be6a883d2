import numpy as np
import pytest

from separatrix.llm import metric_join


def brute_force(rows, cosine):
    """Links and components of (id, label, vector) rows by all pairs."""
    usable = [(i, g, np.array(v, float)) for i, g, v in rows if i is not None and g is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {id(u): 0 for u in usable}
    root = {i: i for i, *_ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(usable):
        for b in usable[n + 1 :]:
            if a[1] == b[1] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= cosine:
                links[id(a)] += 1
                links[id(b)] += 1
                low, high = sorted((find(a[0]), find(b[0])))
                root[high] = low
    count = {u[0]: links[id(u)] for u in usable}
    return {i: (count.get(i, 0), find(i)) for i, *_ in rows}


def clustered(seed, n, dims):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dims))
    return [(int(i), int(rng.integers(2)), (centres[rng.integers(40)] + 0.1 * rng.normal(size=dims)).round(3).tolist()) for i in rng.permutation(n)]


@pytest.mark.parametrize("dims,settings", [(3, metric_join.Settings(cell=25, pivots=(6, 20), per_pivot=8, sample=60, portion=50, most_copies=20)), (24, metric_join.Settings(cell=40, pivots=(4, 16), sample=100, most_copies=20)), (3, metric_join.Settings())])
def test_links_equal_brute_force(spark, dims, settings):
    rows = clustered(dims, 420, dims)
    # A vector that a third of a label repeats.
    rows += [(1000 + i, 0, [1.0] * dims) for i in range(60)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, cell string, links int")
    rows = [(i, g, np.array(v, np.float32).astype(float).tolist()) for i, g, v in rows]
    got = metric_join.range_links(frame, settings=settings).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute_force(rows, 0.98) and len(got) == len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_splits_save_work(spark):
    from separatrix.llm.scratch import Scratch

    settings = metric_join.Settings(cell=25, pivots=(6, 6), most_copies=20)
    rows = clustered(3, 400, 3)
    frame = spark.createDataFrame(rows, "key long, label int, vector array<double>").selectExpr("'c' AS cell", "key", "1L AS copies", "vector")
    cells = metric_join._cells(frame, Scratch(spark), settings).collect()
    assert len({r["cell"] for r in cells}) > 4 and sorted(r["key"] for r in cells if r["home"]) == list(range(400))


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 0.0], None, [], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 0.0, 0.0], [1e-200, 0.0], [1e200, 0.0]]
    rows = [(i, 1, v) for i, v in enumerate(vectors)] + [(20, None, [1.0, 0.0]), (21, 2, [1.0, 0.0]), (None, 1, [1.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in metric_join.range_links(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    for i in (0, 1, 2, 10, 11):
        assert got[i] == (4, 0, i == 0)
    for i in (3, 4, 5, 6, 7, 8, 9, 20, 21):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, True)
    assert metric_join.range_links(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_repeated_rows_count(spark):
    rows = [(5, 1, [1.0, 0.1]), (5, 1, [1.0, 0.1]), (3, 1, [1.0, 0.1])]
    got = metric_join.range_links(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(3, 2, 3), (5, 2, 3), (5, 2, 3)]


def test_clusters_of_many_dimensions_are_pruned(spark):
    from separatrix.llm.scratch import Scratch

    rng = np.random.default_rng(8)
    centres = rng.normal(size=(50, 64))
    which = rng.integers(50, size=4000)
    vectors = centres[which] + 0.05 * rng.normal(size=(4000, 64))
    frame = spark.createDataFrame([("c", i, 1, v.tolist()) for i, v in enumerate(vectors)], "cell string, key long, copies long, vector array<double>")
    cells = metric_join._cells(frame, Scratch(spark), metric_join.Settings(cell=200)).select("cell", "key", "home").toPandas()
    sizes = cells.groupby("cell")["home"].agg(["size", "sum"])
    # Few copies, and few of the 16 million comparisons are left.
    assert sorted(cells.loc[cells["home"], "key"]) == list(range(4000)) and len(cells) < 1.2 * 4000
    assert (sizes["size"] * sizes["sum"]).sum() < 0.05 * 4000**2


def test_a_key_with_several_vectors(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 1, [0.0, 2.0]), (3, 1, [1.0, 0.01]), (0, 1, [0.01, 1.0]), (None, 1, [1.0, 0.0])]
    got = metric_join.range_links(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None) == [
        (False, 0, 2, 0), (False, 1, 1, 1), (False, 1, 2, 0), (False, 2, 2, 0), (False, 3, 1, 1)
    ]
    assert len(got) == len(rows)
