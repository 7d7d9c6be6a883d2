"""Vector algebra, affine scores, links and thresholds as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from separatrix.functions.hashing import _col

# Sums with more literal terms than this become a higher-order function, which
# keeps the generated code of a stage small.
UNROLL_LIMIT = 256


def _total(terms: Sequence[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def dot(vector, weights: Sequence[float]) -> Column:
    """Dot product of an array column with fixed weights.

    Null for a null vector or a null element; a vector of another length than the
    weights is an error.
    """
    vector = _col(vector)
    if not weights:
        total = F.lit(0.0)
    elif len(weights) <= UNROLL_LIMIT:
        total = _total([F.lit(float(w)) * F.get(vector, F.lit(j)) for j, w in enumerate(weights)])
    else:
        fixed = F.array(*[F.lit(float(w)) for w in weights])
        total = F.aggregate(
            F.zip_with(vector, fixed, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v
        )
    message = F.concat(F.lit(f"{len(weights)} weights, vector of length "), F.size(vector).cast("string"))
    return (
        F.when(vector.isNull(), F.lit(None).cast("double"))
        .when(F.size(vector) == len(weights), total)
        .otherwise(F.raise_error(message).cast("double"))
    )


def length(vector) -> Column:
    """Euclidean length of an array column."""
    squares = F.aggregate(
        _col(vector), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")
    )
    return F.sqrt(squares)


def normalize(vector) -> Column:
    """Unit vector; all null for a zero vector."""
    size = F.nullif(length(vector), F.lit(0.0))
    return F.transform(_col(vector), lambda v: v.cast("double") / size)


def signed_distance(vector, theta: Sequence[float], theta0: float) -> Column:
    """Signed distance of a point to the hyperplane ``theta . x + theta0 = 0``."""
    norm = sum(float(t) * float(t) for t in theta) ** 0.5
    return (dot(vector, theta) + F.lit(float(theta0))) / F.lit(norm)


def side(vector, theta: Sequence[float], theta0: float) -> Column:
    """-1, 0 or +1: the side of the hyperplane a point is on."""
    return F.signum(dot(vector, theta) + F.lit(float(theta0)))


def affine(columns: Sequence, weights: Sequence[float]) -> Column:
    """``w0 + w1 x1 + ...`` over scalar columns; ``weights[0]`` is the intercept."""
    terms = [F.lit(float(w)) * _col(c) for c, w in zip(columns, weights[1:], strict=True)]
    return _total([F.lit(float(weights[0])), *terms])


def link(score) -> Column:
    """Probability of the positive class, ``1 / (1 + exp(-score))``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(score)))


def sign_inclusive(score) -> Column:
    """+1 from 0 upwards, else -1 (perceptron and Adaline)."""
    return F.when(_col(score) >= 0, 1).otherwise(-1)


def sign_strict(score) -> Column:
    """+1 above 0, else -1 (logistic models)."""
    return F.when(_col(score) > 0, 1).otherwise(-1)


def log1p_exp_neg(score) -> Column:
    """``ln(1 + exp(-score))`` that cannot overflow."""
    score = _col(score)
    return F.greatest(-score, F.lit(0.0)) + F.log1p(F.exp(-F.abs(score)))


def exclusive_or(a: Column, b: Column) -> Column:
    """True when exactly one of two conditions holds."""
    return a != b
