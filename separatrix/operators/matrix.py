"""Matrix product of coordinate tables ``(i, j, v)`` by dense tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TILE = 32


def _tiles(entries: DataFrame, row: str, col: str, tile: int) -> DataFrame:
    """Tiles ``(bi, bj, cells)``; equal coordinates are added up before tiles are formed."""
    cells = entries.groupBy(row, col).agg(F.sum("v").alias("v"))
    packed = F.struct(
        (F.col(row) % tile).cast("int").alias("r"),
        (F.col(col) % tile).cast("int").alias("c"),
        F.col("v").cast("double").alias("v"),
    )
    return cells.groupBy(
        F.floor(F.col(row) / tile).alias("bi"), F.floor(F.col(col) / tile).alias("bj")
    ).agg(F.collect_list(packed).alias("cells"))


def _dense(cells, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of a tile, and 1 where it has an entry."""
    out, present = np.zeros((tile, tile)), np.zeros((tile, tile), np.float32)
    flat = cells.values
    r, c, v = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("r", "c", "v"))
    out[r, c], present[r, c] = v, 1.0
    return out, present


def multiply(a: DataFrame, b: DataFrame, tile: int = TILE, salts: int = 4) -> DataFrame:
    """``(i, j, v)`` of the product of ``a`` and ``b``, both ``(i, j, v)`` with i, j >= 0.

    Tiles meet on the inner tile index; a pair of tiles yields one tile of partial
    sums, not one row per pair of entries. A tile holds ``tile**2`` cells at most.
    ``salts`` spreads the left tiles of one inner index over that many shuffle keys.
    """
    left = _tiles(a, "i", "j", tile).select(
        "bi",
        F.col("bj").alias("bk"),
        (F.col("bi") % salts).cast("int").alias("salt"),
        F.col("cells").alias("a"),
    )
    right = _tiles(b, "i", "j", tile).select(
        F.col("bi").alias("bk"),
        "bj",
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        F.col("cells").alias("b"),
    )
    pairs = left.join(right, ["bk", "salt"]).select("bi", "bj", "a", "b")

    def products(batches):
        for batch in batches:
            lists_a, lists_b = batch.column("a"), batch.column("b")
            sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
            for n, place in enumerate(
                zip(batch.column("bi").to_pylist(), batch.column("bj").to_pylist(), strict=True)
            ):
                (a, in_a), (b, in_b) = _dense(lists_a[n], tile), _dense(lists_b[n], tile)
                part, met = a @ b, in_a @ in_b > 0
                if place in sums:
                    part, met = sums[place][0] + part, sums[place][1] | met
                sums[place] = part, met
            for (bi, bj), (part, met) in sums.items():
                # Cells whose terms add up to zero are cells of the product, too.
                r, c = np.nonzero(met)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bi * tile + r), pa.array(bj * tile + c), pa.array(part[r, c])],
                    names=["i", "j", "v"],
                )

    return (
        pairs.mapInArrow(products, "i long, j long, v double")
        .groupBy("i", "j")
        .agg(F.sum("v").alias("v"))
    )
