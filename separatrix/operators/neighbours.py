"""Exact k nearest neighbours as a pivot-partitioned join.

After Lu, Shen, Chen, Ooi (VLDB 2012): training points go to the cell of their
nearest pivot, and the triangle inequality tells which cells can hold a
neighbour of a query point. A query visits those cells only. Cells near each other
form a region, and a query is sent once to each region with a cell it visits. Regions
with many points or many queries are cut into chunks, so a group has a bounded size; within
a group numpy finds the ``k`` best, and only these leave the task. Nothing but the
pivots and one line of statistics per cell is shared with all tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from separatrix.functions.hashing import key_digest
from separatrix.storage import materialize, parallelism

# Rows of either side in one group.
GROUP_ROWS = 50_000
# Distances computed at once inside a group.
BLOCK_CELLS = 500_000
# Upper bound on the number of pivots, whatever the table size.
MAX_PIVOTS = 2048
# Rows measured against all pivots at once.
SLICE = 256
# Candidates that a group keeps before it drops all but the ``k`` best of each query.
MOST_CANDIDATES = 250_000


def _points(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.unique(np.diff(column.offsets.to_numpy()))
    if len(sizes) > 1:
        raise ValueError(f"points of different lengths: {sizes.tolist()}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def _pivots(train: DataFrame, n: int) -> np.ndarray:
    """A fixed pseudo-random choice of distinct training points."""
    count = max(1, min(MAX_PIVOTS, math.isqrt(n)))
    drawn = train.orderBy(key_digest("id", "pivot"), "id").limit(count).collect()
    return np.unique(np.array([r["x"] for r in drawn], dtype=float), axis=0)


def _assigned(train: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Training points with the cell of their nearest pivot and their distance to it."""
    def measure(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _distances(points, pivots)
        cell = d.argmin(1)
        return cell, d[np.arange(len(d)), cell]

    def assign(batches):
        for batch in batches:
            points = _points(batch.column("x"))
            parts = [measure(points[at:at + SLICE]) for at in range(0, len(points), SLICE)]
            if parts:
                cell, r = (np.concatenate(c) for c in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype("int32")), pa.array(r)],
                    names=[*batch.schema.names, "cell", "r"],
                )

    schema = train.schema.simpleString()[len("struct<"):-1]
    return train.mapInArrow(assign, f"{schema},cell:int,r:double")


def _visits(queries: DataFrame, pivots: np.ndarray, sizes: np.ndarray, radii: np.ndarray, k: int) -> DataFrame:
    """Queries with the ``cells`` that may hold one of their ``k`` nearest points."""
    between = _distances(pivots, pivots)
    wanted = min(k, int(sizes.sum()))
    filled = sizes > 0
    scale = 1.0 + np.abs(pivots).max(initial=0.0)

    def reach(points: np.ndarray) -> np.ndarray:
        d = _distances(points, pivots)
        # All points of a cell lie within the distance to its pivot plus its radius, so
        # the nearest such cells with k points together bound the k-th distance.
        farthest = np.where(filled, d + radii, np.inf)
        order = farthest.argsort(1)
        enough = (sizes[order].cumsum(1) >= wanted).argmax(1)
        rows = np.arange(len(d))
        bound = farthest[rows, order[rows, enough]]
        bound = bound + 1e-6 * (scale + bound + np.abs(points).max(1, initial=0.0))
        # A cell is out of reach behind its own radius, or behind the plane halfway
        # between its pivot and the query's own.
        own = d.argmin(1)
        gap = between[own]
        plane = (d * d - (d[rows, own] ** 2)[:, None]) / np.where(gap > 0, 2.0 * gap, np.inf)
        return filled & (np.maximum(d - radii, plane) <= bound[:, None])

    def visit(batches):
        for batch in batches:
            points = _points(batch.column("x"))
            for at in range(0, len(points), SLICE):
                part = batch.slice(at, SLICE)
                hit_row, hit_cell = np.nonzero(reach(points[at:at + SLICE]))
                offsets = np.r_[0, np.bincount(hit_row, minlength=part.num_rows).cumsum()]
                cells = pa.ListArray.from_arrays(
                    pa.array(offsets.astype("int32")), pa.array(hit_cell.astype("int32"))
                )
                yield pa.RecordBatch.from_arrays([*part.columns, cells], names=[*part.schema.names, "cells"])

    schema = queries.schema.simpleString()[len("struct<"):-1]
    return queries.mapInArrow(visit, f"{schema},cells:array<int>")


def _regions(pivots: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Region of each cell: cells near each other, ``most`` rows or one cell."""
    region, todo, n = np.zeros(len(sizes), dtype="int64"), [np.arange(len(sizes))], 0
    while todo:
        cells = todo.pop()
        if len(cells) > 1 and sizes[cells].sum() > most:
            widest = np.ptp(pivots[cells], axis=0).argmax()
            cells = cells[pivots[cells, widest].argsort(kind="stable")]
            rows = sizes[cells].cumsum()
            half = min(int(np.searchsorted(rows, rows[-1] / 2)) + 1, len(cells) - 1)
            todo += [cells[half:], cells[:half]]
        else:
            region[cells], n = n, n + 1
    return region


def _sent(visits: DataFrame, region: np.ndarray, sizes: np.ndarray) -> DataFrame:
    """A row for each query and region it visits, with the ``cells`` there; none stand for all."""
    whole = np.bincount(region[sizes > 0], minlength=len(region))

    def send(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                lists = part.column("cells")
                cell = lists.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                order = np.lexsort((region[cell], row))
                row, cell = row[order], cell[order]
                there = region[cell]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (there[1:] != there[:-1])]) if len(row) else np.zeros(0, int)
                n = np.diff(np.r_[first, len(row)])
                some = n < whole[there[first]]
                kept = pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.where(some, n, 0).cumsum()].astype("int32")), pa.array(cell[np.repeat(some, n)].astype("int32"))
                )
                queries = part.select(["qid", "x"]).take(pa.array(row[first]))
                yield pa.RecordBatch.from_arrays([*queries.columns, pa.array(there[first].astype("int32")), kept], names=["qid", "x", "region", "cells"])

    schema = visits.select("qid", "x").schema.simpleString()[len("struct<"):-1]
    return visits.mapInArrow(send, f"{schema},region:int,cells:array<int>")


def _pairs(points: np.ndarray, ids: np.ndarray, wanted: np.ndarray, k: int):
    """``(query, point, distance)`` by position: the ``k`` nearest points of each query."""
    block = max(1, BLOCK_CELLS // len(ids))
    take = min(k, len(ids))
    for start in range(0, len(wanted), block):
        q = wanted[start:start + block]
        rough = _distances(q, points)
        kth = np.partition(rough, take - 1, axis=1)[:, take - 1]
        slack = 1e-6 * (1.0 + kth + np.abs(q).max(1, initial=0.0))
        qi, ti = np.nonzero(rough <= (kth + slack)[:, None])
        exact = np.empty(len(qi))
        for piece in range(0, len(qi), 65536):
            part = slice(piece, piece + 65536)
            exact[part] = np.sqrt(((q[qi[part]] - points[ti[part]]) ** 2).sum(1))
        best = _best(qi, ids[ti], exact, k)
        yield qi[best] + start, ti[best], exact[best]


def _best(query: np.ndarray, ids: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` nearest of each query, smaller ids first among equals."""
    order = np.lexsort((ids, distance, query))
    first = np.searchsorted(query[order], query[order])
    return order[np.arange(len(order)) - first < k]


def _nearest(group_train: pa.Table, group_queries: pa.Table, k: int) -> pa.Table:
    """The ``k`` nearest points of each query among those in the cells it visits."""
    ids, labels, cell = (group_train.column(c).to_numpy() for c in ("id", "label", "cell"))
    qids = group_queries.column("qid").to_numpy()
    held = [np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)]
    if len(ids) and len(qids):
        points, wanted = _points(group_train.column("x")), _points(group_queries.column("x"))
        lists = group_queries.column("cells").combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        everywhere = np.flatnonzero(n == 0)
        visitor, visited = np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy(zero_copy_only=False)
        by_cell = np.argsort(visited, kind="stable")
        visitor, visited = visitor[by_cell], visited[by_cell]
        order = np.argsort(cell, kind="stable")
        found, size = [held], 0

        def compare(rows: np.ndarray, asking: np.ndarray) -> None:
            nonlocal found, size
            if not len(rows) or not len(asking):
                return
            for qi, ti, exact in _pairs(points[rows], ids[rows], wanted[asking], k):
                found.append([asking[qi], rows[ti], exact])
                size += len(qi)
                if size > MOST_CANDIDATES:
                    found = [reduced()]
                    # What is left counts from nothing, or each block would sort it again.
                    size = 0

        def reduced() -> list[np.ndarray]:
            query, at, distance = (np.concatenate(c) for c in zip(*found, strict=True))
            best = _best(query, ids[at], distance, k)
            return [query[best], at[best], distance[best]]

        for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            one = cell[rows[0]]
            compare(rows, visitor[np.searchsorted(visited, one):np.searchsorted(visited, one, "right")])
        # Queries that visit all cells meet all points at once.
        compare(order, everywhere)
        held = reduced()
    query, at, distance = held
    return pa.table(
        [pa.array(qids[query].astype("int64")), pa.array(ids[at].astype("int64")), pa.array(labels[at].astype("int64")), pa.array(distance)],
        names=["qid", "id", "label", "distance"],
    )


def _spread(df: DataFrame, chunks: DataFrame, key: str, own: str, other: str) -> DataFrame:
    """Give a row its own chunk of its region, and one copy per chunk of the other side.

    ``chunks`` has one row per region, so it is small enough for every task.
    """
    chunk = F.pmod(F.xxhash64(key), F.col(f"{own}_count")).cast("int")
    copies = F.sequence(F.lit(0), F.col(f"{other}_count") - 1)
    return (
        df.join(F.broadcast(chunks), "region")
        .withColumn(own, chunk)
        .withColumn(other, F.explode(copies))
        .drop(f"{own}_count", f"{other}_count")
    )


def _exact(df: DataFrame) -> Column:
    """Points as they move: single precision stays, as doubles made of it say no more."""
    return F.col("x") if df.schema["x"].dataType.simpleString() == "array<float>" else F.col("x").cast("array<double>")


def neighbours(train: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """``(qid, id, label, distance, rank)`` of the ``k`` nearest training points.

    ``train`` has ``id``, ``label`` (whole numbers) and ``x`` (array of doubles),
    ``queries`` has ``qid`` and ``x``. Ties in distance go to the smaller id. Rows with
    a null point are left out; points of different lengths are an error.

    Of copies of one point only the ``k`` smallest ids can be among the nearest, so
    the others are left out first; most of them before the shuffle.
    """
    train = train.select(
        F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
        _exact(train).alias("x"),
    ).filter("x is not null")
    queries = queries.select(
        F.col("qid").cast("long").alias("qid"), _exact(queries).alias("x")
    ).filter("x is not null")
    pivots = _pivots(train, train.count())
    cells = len(pivots)
    copies = Window.partitionBy("x").orderBy("id")
    train = train.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k).drop("_copy")
    assigned = materialize(_assigned(train, pivots), "neighbour-cells")
    sizes, radii = np.zeros(cells, dtype="int64"), np.zeros(cells)
    for cell, n, r in assigned.groupBy("cell").agg(F.count("*"), F.max("r")).collect():
        sizes[cell], radii[cell] = n, r
    visits = materialize(_visits(queries, pivots, sizes, radii, k), "neighbour-visits")
    n, asked = int(sizes.sum()), visits.count()
    # Cells that no query visits drop out here.
    visited = np.zeros(cells, dtype="int64")
    for cell, count in visits.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*")).collect():
        visited[cell] = count
    # Regions of many cells: a query goes to each once, whatever the number of cells. The larger
    # the share of pairs that are compared, the fewer and larger they are.
    share = float((visited * sizes).sum()) / max(1, n * asked)
    wanted = max(1, math.ceil(math.sqrt(2 * parallelism(train) / max(share, 1e-9))))
    region = _regions(pivots, sizes, min(GROUP_ROWS, max(1, -(-n // wanted))))
    queries_each = min(GROUP_ROWS, max(1, -(-asked // wanted)))
    sent = materialize(_sent(visits, region, sizes), "neighbour-queries")
    counts = {r["region"]: r["count"] for r in sent.groupBy("region").count().collect()}
    rows = np.bincount(region, weights=sizes, minlength=len(region))
    chunks = train.sparkSession.createDataFrame(
        [(r, -(-int(rows[r]) // GROUP_ROWS), -(-count // queries_each)) for r, count in counts.items()],
        "region int, tc_count int, qc_count int",
    )
    place = train.sparkSession.createDataFrame([(c, int(r)) for c, r in enumerate(region)], "cell int, region int")
    left = _spread(assigned.drop("r").join(F.broadcast(place), "cell"), chunks, "id", "tc", "qc")
    right = _spread(sent, chunks, "qid", "qc", "tc")
    group = ["region", "tc", "qc"]

    def join(a: pa.Table, b: pa.Table) -> pa.Table:
        return _nearest(a, b, k)

    candidates = (
        left.groupBy(*group)
        .cogroup(right.groupBy(*group))
        .applyInArrow(join, "qid long, id long, label long, distance double")
    )
    best = Window.partitionBy("qid").orderBy("distance", "id")
    return candidates.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def vote(found: DataFrame) -> DataFrame:
    """``(qid, prediction)`` by majority; the smaller label wins ties."""
    votes = found.groupBy("qid", "label").agg(F.count("*").alias("n"))
    winner = F.max(F.struct(F.col("n"), (-F.col("label")).alias("minus"))).alias("w")
    return votes.groupBy("qid").agg(winner).select(
        "qid", (-F.col("w.minus")).cast("int").alias("prediction")
    )


def classify(train: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """Class of every query by its ``k`` nearest training points."""
    return vote(neighbours(train, queries, k))
