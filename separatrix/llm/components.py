"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from separatrix.llm.scratch import Scratch


def _large(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    return moved.select("b", F.col("m")).union(least.select(F.col("a").alias("b"), "m")).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns a, b) but those that are the least of theirs.

    The component is its least node. Each round is written to the shared folder, so lineage
    stays short; rounds end when nothing changes. Nodes with very many links are joined with
    one row each, and adaptive execution splits such joins.
    """
    oriented = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = scratch.keep(oriented.distinct(), "edges")
    before = _mark(edges)
    while before[0]:
        edges = scratch.keep(_small(_large(edges).distinct()).distinct(), "edges")
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
