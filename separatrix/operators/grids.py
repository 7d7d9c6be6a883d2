"""Points of a plane grid over the extents of a table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from separatrix.operators.tables import extents


# Points of a grid; one outlier makes a grid grow with the square of its distance.
MOST_CELLS = 100_000_000


def grid(df: DataFrame, x: str, y: str, step: float = 0.02, margin: float = 1.0) -> DataFrame:
    """``(cell, x, y)`` for every grid point of ``[min - margin, max + margin)``.

    A cell number alone gives the point, so the grid is a distributed range and
    not the output of one row. More than ``MOST_CELLS`` points are an error: take a larger step.
    """
    box = extents(df, [x, y], margin).first()
    x_lo, y_lo = box[f"{x}_lo"], box[f"{y}_lo"]
    nx = max(0, math.ceil((box[f"{x}_hi"] - x_lo) / step))
    ny = max(0, math.ceil((box[f"{y}_hi"] - y_lo) / step))
    if nx * ny > MOST_CELLS:
        raise ValueError(f"{nx} x {ny} grid points exceed {MOST_CELLS}")
    cells = df.sparkSession.range(nx * ny)
    return cells.select(
        F.col("id").alias("cell"),
        (F.lit(x_lo) + (F.col("id") % max(nx, 1)) * F.lit(step)).alias(x),
        (F.lit(y_lo) + F.floor(F.col("id") / max(nx, 1)) * F.lit(step)).alias(y),
    )
