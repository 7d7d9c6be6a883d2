"""Reproducible sampling: every choice depends on the row key and a seed only.

Keys must be unique. No operator here sorts a whole table in one task: ranks are
taken inside hash buckets, which are even because the digest is uniform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from separatrix.functions.hashing import key_digest, stable_uniform

# 16**4 buckets: the leading four hex digits of a digest.
BUCKET_DIGITS = 4


def in_fraction(key, fraction: float, seed) -> Column:
    """True for about ``fraction`` of the rows."""
    return stable_uniform(key, seed) < F.lit(float(fraction))


def random_split(df: DataFrame, key: str, fraction: float, seed, tag: str = "split",
                 names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Tag every row with the part it falls into; one map-only pass."""
    first, second = names
    return df.withColumn(tag, F.when(in_fraction(key, fraction, seed), first).otherwise(second))


def sample(df: DataFrame, key: str, fraction: float, seed) -> DataFrame:
    """About ``fraction`` of the rows."""
    return df.filter(in_fraction(key, fraction, seed))


def balance_classes(df: DataFrame, key: str, label: str, seed) -> DataFrame:
    """Undersample every class to about the size of the smallest one.

    The kept share of a class is ``n_min / n_class``. Only the class counts are
    aggregated; the rows themselves are filtered where they are. Rows without a
    label are left out.
    """
    counts = df.select(label).filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    # One structure, so that all figures come from one subquery.
    sizes = counts.agg(
        F.struct(
            F.min("n").alias("least"),
            F.map_from_entries(F.collect_list(F.struct(F.col(label), "n"))).alias("of"),
        )
    ).scalar()
    share = sizes.getField("least").cast("double") / F.element_at(sizes.getField("of"), F.col(label))
    return df.filter(stable_uniform(key, seed) < share)


def hash_rank(df: DataFrame, key: str, seed, *more, rank: str = "position") -> DataFrame:
    """Number all rows from 1 in digest order, without a single-task sort.

    Rows are ranked inside digest buckets; the bucket sizes (65,536 at most) give
    the offset of each bucket.
    """
    digest = key_digest(key, seed, *more)
    keyed = df.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    sizes = (
        df.select(F.substring(digest, 1, BUCKET_DIGITS).alias("_b"))
        .groupBy("_b")
        .agg(F.count("*").alias("_n"))
    )
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_b").orderBy("_h", key)
    return (
        keyed.withColumn("_r", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_b")
        .withColumn(rank, F.col("_before") + F.col("_r"))
        .drop("_h", "_b", "_r", "_before")
    )


def shuffle_order(df: DataFrame, key: str, seed, epoch: int) -> DataFrame:
    """The permutation of one epoch as a ``position`` from 1 on."""
    return hash_rank(df, key, seed, epoch)


def exact_split(df: DataFrame, key: str, test_share: float, seed, tag: str = "split") -> DataFrame:
    """Tag exactly ``ceil(n * test_share)`` rows as test, the others as train.

    The test rows are those with the smallest ``(digest, key)``. Two passes over the
    key column find the cut: the bucket sizes tell which bucket has it, and that
    bucket's rows are ranked. The rows themselves are tagged without a shuffle.
    """
    digest = key_digest(key, seed)
    hashed = df.select(F.col(key).alias("_k"), digest.alias("_h"))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    # Windows without a partition see one row per bucket here, 65,536 at most.
    through = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    wanted = F.ceil(F.sum("_n").over(Window.partitionBy()) * F.lit(float(test_share)))
    cut_bucket = (
        hashed.groupBy("_b")
        .agg(F.count("*").alias("_n"))
        .withColumns({"_through": through, "_wanted": wanted})
        .withColumn("_r", F.col("_wanted") - F.col("_through") + F.col("_n"))
        .filter((F.col("_r") > 0) & (F.col("_r") <= F.col("_n")))
        .select(F.struct("_b", "_r"))
        .scalar()
    )
    inside = Window.partitionBy("_b").orderBy("_h", "_k")
    cut = (
        hashed.filter(F.col("_b") == cut_bucket.getField("_b"))
        .withColumn("_rank", F.row_number().over(inside))
        .filter(F.col("_rank") == cut_bucket.getField("_r"))
        .select(F.struct("_h", "_k").alias("_cut"))
    )
    mine = F.struct(digest.alias("_h"), F.col(key).alias("_k"))
    return df.withColumn(tag, F.when(mine <= cut.scalar(), "test").otherwise("train"))
