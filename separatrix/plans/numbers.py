"""Queries: standardization, vectors, matrix product, links and thresholds."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from separatrix.functions import vectors as vc
from separatrix.operators import matrix, metrics, tables
from separatrix.operators.estimators import fourier_features, fourier_projection
from separatrix.plans import fixtures as fx
from separatrix.plans.registry import query, rounded, six

with_sql = fx.with_sql

DIMS = 64
# A fixed hyperplane for geometry queries: any smooth sequence will do.
THETA = [round(math.sin(j + 1.0), 3) for j in range(DIMS)]
THETA0 = 0.05
_THETA_SQL = "[" + ", ".join(f"{t}::DOUBLE" for t in THETA) + "]"
_DOT_SQL = (
    f"list_sum(list_transform(list_zip(embedding::DOUBLE[], {_THETA_SQL}), lambda p: p[1] * p[2]))"
)
_NORM_SQL = f"{math.sqrt(sum(t * t for t in THETA))!r}::DOUBLE"
_LENGTH_SQL = "sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v)))"

# Fixed weights for scoring queries: intercept, x0, x1.
WEIGHTS = [0.25, -1.5, 0.75]
_SCORE_SQL = f"({WEIGHTS[0]}::DOUBLE + {WEIGHTS[1]}::DOUBLE * x0 + {WEIGHTS[2]}::DOUBLE * x1)"


@query(
    "F1",
    """SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) + 0.0::DOUBLE AS value
    FROM events""",
)
def standardized(spark, folder):
    events = fx.table(spark, folder, "events").select("event_id", "value")
    return rounded(tables.standardize(events, ["value"]))


@query("F2", f"SELECT vec_id, round({_LENGTH_SQL}, 6) AS length FROM embeddings")
def vector_length(spark, folder):
    vectors = fx.table(spark, folder, "embeddings")
    return rounded(vectors.select("vec_id", vc.length("embedding").alias("length")))


@query(
    "F3",
    f"""SELECT vec_id, dim, round(v / len, 6) + 0.0::DOUBLE AS v FROM (SELECT vec_id, {_LENGTH_SQL} AS len,
        unnest(embedding::DOUBLE[]) AS v, (unnest(range(len(embedding))))::INTEGER AS dim FROM embeddings) t""",
)
def unit_vectors(spark, folder):
    vectors = fx.table(spark, folder, "embeddings")
    unit = vectors.select("vec_id", vc.normalize("embedding").alias("u"))
    return rounded(unit.select("vec_id", F.posexplode_outer("u").alias("dim", "v")))


@query(
    "F4 F5",
    f"""SELECT vec_id, round(({_DOT_SQL} + {THETA0}::DOUBLE) / {_NORM_SQL}, 6) + 0.0::DOUBLE AS distance,
        sign({_DOT_SQL} + {THETA0}::DOUBLE)::INTEGER AS side FROM embeddings""",
)
def hyperplane_distance(spark, folder):
    vectors = fx.table(spark, folder, "embeddings")
    return rounded(
        vectors.select(
            "vec_id",
            vc.signed_distance("embedding", THETA, THETA0).alias("distance"),
            vc.side("embedding", THETA, THETA0).cast("int").alias("side"),
        )
    )


@query(
    "F6",
    """WITH e AS MATERIALIZED (SELECT vec_id, (unnest(range(len(embedding)))) AS dim,
        unnest(embedding::DOUBLE[]) AS v FROM embeddings)
    SELECT a.dim AS i, b.dim AS j, round(sum(a.v * b.v), 6) + 0.0::DOUBLE AS v
    FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY a.dim, b.dim""",
)
def matrix_product(spark, folder):
    """The product of the transposed embedding matrix with itself."""
    vectors = fx.table(spark, folder, "embeddings")
    cells = vectors.select("vec_id", F.posexplode("embedding").alias("dim", "v"))
    whole = cells.select(F.col("vec_id").alias("i"), F.col("dim").alias("j"), F.col("v").cast("double").alias("v"))
    turned = whole.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return rounded(matrix.multiply(turned, whole))


@query(
    "F7 F8 F9 F10 F11",
    with_sql(
        "flowers",
        f"""SELECT flower_id, round(s, 6) + 0.0::DOUBLE AS score, round(1 / (1 + exp(-s)), 6) AS probability,
            CASE WHEN s >= 0 THEN 1 ELSE -1 END AS inclusive, CASE WHEN s > 0 THEN 1 ELSE -1 END AS strict,
            round(greatest(-s, 0) + ln(1 + exp(-abs(s))), 6) AS softplus
        FROM (SELECT flower_id, {_SCORE_SQL} AS s FROM flowers) t""",
    ),
)
def links_and_thresholds(spark, folder):
    scored = fx.flowers(spark, folder).select("flower_id", vc.affine(["x0", "x1"], WEIGHTS).alias("score"))
    return scored.select(
        "flower_id",
        six(F.col("score")).alias("score"),
        six(vc.link("score")).alias("probability"),
        vc.sign_inclusive("score").alias("inclusive"),
        vc.sign_strict("score").alias("strict"),
        six(vc.log1p_exp_neg("score")).alias("softplus"),
    )


@query(
    "F13 G3",
    """SELECT o_orderpriority, n, round(n::DOUBLE / sum(n) OVER (), 6) AS share
    FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority) t""",
)
def value_distribution(spark, folder):
    return rounded(metrics.distribution(fx.table(spark, folder, "orders"), "o_orderpriority"))


PROJECTION = fourier_projection(2, 0.1, 24, seed=0)
_PROJECTION_SQL = ", ".join(
    f"({j}, {float(b)!r}::DOUBLE, {float(w0)!r}::DOUBLE, {float(w1)!r}::DOUBLE)"
    for j, (b, w0, w1) in enumerate(PROJECTION)
)


@query(
    "I13",
    with_sql(
        "quadrants",
        f"""SELECT point_id, j, round(sqrt(2.0::DOUBLE / {len(PROJECTION)}) * cos(b + w0 * x0 + w1 * x1), 6)
            + 0.0::DOUBLE AS z
        FROM quadrants CROSS JOIN (VALUES {_PROJECTION_SQL}) AS p(j, b, w0, w1)""",
    ),
)
def fourier_map(spark, folder):
    """The random Fourier features behind the Gaussian-kernel classifier."""
    points = fx.quadrants(spark, folder)
    mapped = points.select("point_id", fourier_features(["x0", "x1"], PROJECTION).alias("f"))
    return rounded(mapped.select("point_id", F.posexplode("f").alias("j", "z")))
