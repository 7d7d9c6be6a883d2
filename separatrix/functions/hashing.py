"""Uniform numbers and orders that depend on a row's key, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_digest(key, seed, *more) -> Column:
    """32 hex digits from the row key, the seed and any further values."""
    parts = [_col(key).cast("string"), F.lit(str(seed)), *[F.lit(str(m)) for m in more]]
    return F.md5(F.concat_ws(":", *parts))


def stable_uniform(key, seed, *more) -> Column:
    """Uniform double in [0, 1) fixed by key and seed; it grows with the digest."""
    head = F.conv(F.substring(key_digest(key, seed, *more), 1, 8), 16, 10)
    return head.cast("double") / F.lit(4294967296.0)
