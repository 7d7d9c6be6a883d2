"""Exact range join of vectors by cosine, in cells around pivots.

On unit vectors a cosine of c is a distance of sqrt(2 - 2c), a metric. A point's home cell
is that of its nearest pivot. By the triangle inequality a partner within the radius can
live in another cell only if that pivot is at most twice the radius farther away than the
point's own; in Euclidean space the distance to the plane between two pivots narrows this
further. Points are copied to those cells, and each cell finds the partners of its home
points by itself. Pivots lie far apart, so that clusters get pivots of their own, and their
number grows with the cell. Cells that are too large are split again, unless a sample shows
that splitting does not save work; those are joined block by block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from separatrix.llm.components import components
from separatrix.llm.scratch import Scratch


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.98
    cell: int = 1000  # points that are compared with as many others in one task
    per_pivot: int = 32  # points of a cell for each of its pivots
    pivots: tuple[int, int] = (16, 256)  # fewest and most pivots of a cell that is split
    sample: int = 2048  # points that pivots are chosen from, and that a split is judged by
    share: float = 0.5  # a split must leave no more than this share of the comparisons
    most_copies: float = 4.0  # and send a point to no more cells than this on average
    portion: int = 20_000  # points with their copies that one task assigns to pivots


def _points(rows: DataFrame, key: str, vector: str, label: str | None) -> DataFrame:
    """``key, cell, digest, vector`` of every row; all but the key are null where it cannot link. Vectors are doubles."""
    kind = dict(rows.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, digests, vectors = [], [], []
            for whose, cell, value in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                value = value.as_py()
                x = None
                if whose.is_valid and cell.is_valid and value and not any(v is None for v in value):
                    x = np.array(value, np.float64) + 0.0
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                cells.append(None if x is None else f"{len(x)}:{cell.as_py()}")
                digests.append(None if x is None else hashlib.sha256(cells[-1].encode() + b"\0" + x.tobytes()).digest())
                vectors.append(x)
            columns = [batch.column(0), pa.array(cells, pa.string()), pa.array(digests, pa.binary()), pa.array(vectors, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "cell", "digest", "vector"])

    group = F.lit("") if label is None else F.col(label).cast("string")
    narrow = rows.select(F.col(key).alias("key"), group.alias("cell"), F.col(vector).alias("vector"))
    return narrow.mapInArrow(work, f"key {kind}, cell string, digest binary, vector array<double>")


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Unit vectors; scaling first keeps squares of tiny and huge components finite."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _far_apart(x: np.ndarray, most: int, radius: float) -> np.ndarray:
    """Rows of ``x``, each the one farthest from those before it; all rows are within ``radius`` of one, or there are ``most``."""
    chosen, nearest = [0], np.full(len(x), np.inf)
    while True:
        nearest = np.minimum(nearest, 2 - 2 * (x @ x[chosen[-1]]))
        following = int(nearest.argmax())
        if len(chosen) >= most or nearest[following] <= radius**2:
            return np.array(chosen)
        chosen.append(following)


def _visits(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home pivot of each point, and which pivots' cells may hold home points within the radius."""
    far = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ p.T)))
    between = np.sqrt(np.maximum(0.0, 2 - 2 * (p @ p.T)))
    home = far.argmin(axis=1)
    own = far[np.arange(len(x)), home][:, None]
    near = far <= own + 2 * radius
    apart = between[home]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (far**2 - own**2) / (2 * apart)
    near &= (apart < 1e-12) | (plane <= radius)
    near[np.arange(len(x)), home] = True
    return home, near


def _radius(settings: Settings) -> float:
    return math.sqrt(2 - 2 * settings.cosine) + 1e-9


def _judge(points: DataFrame, large: DataFrame, settings: Settings) -> DataFrame:
    """``cell, pivots, share, copies`` of large cells, from a sample of each that has a bounded size.

    ``share`` is the part of the comparisons that a split by these pivots leaves, and
    ``copies`` the number of cells that a point goes to.
    """
    radius = _radius(settings)
    # Home points with the least digests; a threshold keeps the sample short.
    chance = F.pmod(F.xxhash64("key", "cell"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = points.join(large, "cell").filter(F.col("home") & (chance * F.col("homes") <= settings.sample)).select("cell", "key", "vector", "n", "homes")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(group.sort_values("key")["vector"])
        wanted = int(np.clip(group["n"].iloc[0] // settings.per_pivot, *settings.pivots))
        p = x[_far_apart(x, wanted, radius)]
        home, near = _visits(x, p, radius)
        share = float((np.bincount(home, minlength=len(p)) * near.sum(axis=0)).sum()) / len(x) ** 2
        return pd.DataFrame({"cell": [group["cell"].iloc[0]], "pivots": [[v.tolist() for v in p]], "share": [share], "copies": [float(near.sum()) / len(x)]})

    return rows.groupBy("cell").applyInPandas(choose, "cell string, pivots array<array<double>>, share double, copies double")


def _split(points: DataFrame, chosen: DataFrame, settings: Settings) -> DataFrame:
    """Points of the chosen cells (``cell, pivots, n, copies``) with ``sub`` and ``subhome``, a row for each cell they go to."""
    radius = _radius(settings)
    kind = dict(points.dtypes)["key"]
    sized = chosen.select("cell", "pivots", F.ceil(F.col("n") * F.col("copies") / settings.portion).cast("int").alias("parts"))
    pivots = sized.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "pivots")
    rows = points.join(sized.select("cell", "parts"), "cell")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).select("cell", "part", "key", "copies", "vector", "home")

    def assign(points: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        names = ["cell", "key", "copies", "vector", "home", "sub", "subhome"]
        if not len(points) or not len(pivots):
            return points.assign(sub=0, subhome=points["home"])[names]
        home, near = _visits(_matrix(points["vector"]), _matrix(pd.Series(list(pivots["pivots"].iloc[0]))), radius)
        at, sub = np.nonzero(near)
        out = points.iloc[at].assign(sub=sub)
        return out.assign(subhome=out["home"].to_numpy() & (home[at] == sub))[names]

    schema = f"cell string, key {kind}, copies long, vector array<double>, home boolean, sub int, subhome boolean"
    return dealt.groupBy("cell", "part").cogroup(pivots.groupBy("cell", "part")).applyInPandas(assign, schema)


def _cells(points: DataFrame, scratch: Scratch, settings: Settings) -> DataFrame:
    """``cell, key, copies, vector, home``: cells that are small or do not get cheaper."""
    names = ["cell", "key", "copies", "vector", "home"]
    open_points = points.withColumn("home", F.lit(True)).select(*names)
    done, turn = [], 0
    while True:
        sizes = open_points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("long")).alias("homes"))
        large = sizes.filter((F.col("n") > settings.cell) & (F.col("homes") > 0))
        judged = scratch.keep(_judge(open_points, large, settings).join(large, "cell"), f"judged-{turn}")
        chosen = judged.filter((F.col("share") <= settings.share) & (F.col("copies") <= settings.most_copies))
        if chosen.isEmpty():
            done.append(open_points)
            break
        done.append(open_points.join(chosen.select("cell"), "cell", "left_anti"))
        split = scratch.keep(_split(open_points, chosen, settings), f"split-{turn}")
        open_points = split.select(F.concat_ws("/", "cell", "sub").alias("cell"), "key", "copies", "vector", F.col("subhome").alias("home"))
        turn += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _linked(x: np.ndarray, y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every pair with at least that cosine."""
    values = x @ y.T
    at, other = np.nonzero(values >= cosine - 1e-12)
    close = values[at, other] < cosine + 1e-12
    for n in np.flatnonzero(close):
        # Sums of products do not depend on the block here.
        a, b = x[at[n]], y[other[n]]
        close[n] = math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b)) < cosine
    return at[~close], other[~close]


def _join(cells: DataFrame, settings: Settings) -> DataFrame:
    """``key, links, least``: partners of each home point in a block, and the least key of its group there."""
    kind = dict(cells.dtypes)["key"]
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / settings.cell).cast("int").alias("blocks"))
    rows = cells.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # Home points ask, all points answer; a group is one block of either.
    ask = rows.filter("home").select("cell", F.col("block").alias("i"), every.alias("j"), "key", "copies", "vector", F.lit(True).alias("asks"))
    answer = rows.select("cell", every.alias("i"), F.col("block").alias("j"), "key", "copies", "vector", F.lit(False).alias("asks"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy(bool)
        left, right = group[asks], group[~asks]
        if not len(left) or not len(right):
            return pd.DataFrame({"key": [], "links": [], "least": []})
        at, other = _linked(_matrix(left["vector"]), _matrix(right["vector"]), settings.cosine)
        mine, theirs = left["key"].to_numpy(), right["key"].to_numpy()
        differ = mine[at] != theirs[other]
        at, other = at[differ], other[differ]
        links = np.bincount(at, weights=right["copies"].to_numpy()[other], minlength=len(left)).astype(np.int64)
        # Groups of this block: the least rank spreads over links until nothing changes.
        keys, rank = np.unique(np.concatenate((mine, theirs)), return_inverse=True)
        a, b = rank[: len(mine)][at], rank[len(mine) :][other]
        label = np.arange(len(keys))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        touched = np.unique(np.concatenate((a, b)))
        first = pd.DataFrame({"key": mine, "links": links, "least": mine})
        groups = pd.DataFrame({"key": keys[touched], "links": 0, "least": keys[label[touched]]})
        return pd.concat((first[first["links"] > 0], groups[groups["key"] != groups["least"]]))

    return ask.union(answer).groupBy("cell", "i", "j").applyInPandas(compare, f"key {kind}, links long, least {kind}")


def range_links(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", settings: Settings = Settings()
) -> DataFrame:
    """One row for each row of ``rows``: key, ``n_links``, ``component_id``, ``kept``.

    Rows link if their labels are equal and not null (with ``label`` None, always), their
    vectors have one length, and the cosine is at least ``settings.cosine``. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, and so
    do rows with a null key. ``n_links`` counts the other rows linked directly, equal
    vectors among them. ``component_id`` is the least key reachable, and that row is kept.
    Each row counts by its own vector: of a key that comes with several vectors, every row
    has the links and the component of the vector it holds, and these may differ.
    """
    scratch = Scratch(rows.sparkSession)
    stored = scratch.keep(_points(rows, key, vector, label), "points")
    # Equal vectors are one point that counts as often as they come; its number holds, as the table is stored.
    heads = stored.filter("digest is not null").groupBy("digest").agg(
        F.first("cell").alias("cell"), F.first("vector").alias("vector"), F.min("key").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    heads = scratch.keep(heads.withColumn("node", F.monotonically_increasing_id()), "heads")
    points = heads.select("cell", F.col("node").alias("key"), "copies", "vector")
    found = scratch.keep(_join(_cells(points, scratch, settings), settings), "found")
    scratch.drop(*[name for name in scratch.paths if name.startswith(("judged", "split"))])
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    edges = found.filter("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b")).distinct()
    known = components(edges, scratch).withColumnRenamed("node", "known")

    named = heads.join(known, F.col("node") == F.col("known"), "left").withColumn("component", F.coalesce("component", "node"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = named.join(first, "component").join(links, F.col("node") == F.col("key"), "left")
    placed = placed.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = stored.select("key", "digest").join(placed, "digest", "left")
    component = F.coalesce("component_id", "key")
    return out.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("key")).alias("kept")
    )
