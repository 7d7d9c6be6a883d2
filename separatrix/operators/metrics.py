"""Counts, class balance and the quality of predictions, one aggregate each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame, functions as F

from separatrix.functions.hashing import _col
from separatrix.functions.vectors import affine, link, log1p_exp_neg


def hits(condition: Column) -> Column:
    """Number of rows that meet a condition."""
    return F.count_if(condition)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """``(column, n, share)`` of every value of a column."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n").cast("double") / total)


def majority_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Majority class of the training rows and its accuracy on the test rows."""
    majority = (
        train.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(1)
    )
    chosen = majority.select(label).scalar()
    return test.agg(
        F.max(chosen).alias("majority_class"),
        F.count("*").alias("n"),
        hits(F.col(label) == chosen).alias("correct"),
        F.avg(F.when(F.col(label) == chosen, 1.0).otherwise(0.0)).alias("accuracy"),
    )


def accuracy(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """``correct``, ``incorrect``, ``total`` and ``accuracy``, per group if asked."""
    right = F.col(label) == F.col(prediction)
    return df.groupBy(*by).agg(
        hits(right).alias("correct"),
        hits(~right).alias("incorrect"),
        F.count("*").alias("total"),
        F.avg(F.when(right, 1.0).otherwise(0.0)).alias("accuracy"),
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(
        F.col(label).alias("target_label"), F.col(prediction).alias("predicted_label")
    ).agg(F.count("*").alias("n"))


def mistakes(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row of outcome counts for labels +1 and -1."""
    y, p = F.col(label), F.col(prediction)
    return df.agg(
        hits((y == 1) & (p == 1)).alias("true_pos"),
        hits((y == -1) & (p == 1)).alias("false_pos"),
        hits((y == 1) & (p == -1)).alias("false_neg"),
        hits(y == p).alias("correct"),
        F.count("*").alias("total"),
    )


def _ratio(a, b) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _harmonic(a: Column, b: Column) -> Column:
    return F.try_divide(F.lit(2.0) * a * b, a + b)


def precision_recall(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Standard precision, recall and F1, next to two figures based on all correct rows.

    ``correct_over_correct_fn`` counts true negatives as found, and
    ``f1_as_written`` combines it with the accuracy.
    """
    c = {name: F.col(name) for name in ("true_pos", "false_pos", "false_neg", "correct", "total")}
    figures = mistakes(df, label, prediction).select(
        _ratio(c["true_pos"], c["true_pos"] + c["false_pos"]).alias("precision"),
        _ratio(c["true_pos"], c["true_pos"] + c["false_neg"]).alias("recall"),
        _ratio(c["correct"], c["total"]).alias("accuracy"),
        _ratio(c["correct"], c["correct"] + c["false_neg"]).alias("correct_over_correct_fn"),
    )
    return figures.withColumns(
        {
            "f1": _harmonic(F.col("precision"), F.col("recall")),
            "f1_as_written": _harmonic(F.col("accuracy"), F.col("correct_over_correct_fn")),
        }
    )


# Cost of a false negative and of a false positive.
FN_COST, FP_COST = 10000.0, 20000.0


def mistake_cost(
    df: DataFrame, label: str, prediction: str, fn_cost: float = FN_COST, fp_cost: float = FP_COST
) -> DataFrame:
    """Cost of false negatives, of false positives, and their sum."""
    return (
        mistakes(df, label, prediction)
        .select(
            "false_neg",
            "false_pos",
            (F.col("false_neg") * F.lit(fn_cost)).alias("fn_cost"),
            (F.col("false_pos") * F.lit(fp_cost)).alias("fp_cost"),
        )
        .withColumn("total_cost", F.col("fn_cost") + F.col("fp_cost"))
    )


def area_under_roc(df: DataFrame, label: str, score: str) -> float:
    """Exact area under the ROC curve; ties count one half.

    Equal scores are added up before they are range-sorted, so a common score is
    one row and no task sees the whole order.
    """
    scored = df.select(
        F.col(score).cast("double").alias("rawPrediction"),
        F.when(F.col(label) == 1, 1.0).otherwise(0.0).alias("label"),
    )
    return BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0).evaluate(scored)


def likelihood_term(score, label) -> Column:
    """Log likelihood of one row: ``(1[y=+1] - 1) s - ln(1 + exp(-s))``."""
    score = _col(score)
    negative = F.when(_col(label) == 1, 0.0).otherwise(-1.0)
    return negative * score - log1p_exp_neg(score)


def log_likelihood(
    df: DataFrame, columns: Sequence[str], label: str, weights: Sequence[float], l2: float = 0.0
) -> DataFrame:
    """Log likelihood of fixed weights, less ``l2`` times their squares without intercept."""
    penalty = float(l2) * sum(float(w) ** 2 for w in weights[1:])
    term = likelihood_term(affine(columns, weights), label)
    return df.agg((F.sum(term) - F.lit(penalty)).alias("log_likelihood"))


def gradient(
    df: DataFrame, columns: Sequence[str], label: str, weights: Sequence[float], l2: float = 0.0
) -> DataFrame:
    """``(idx, derivative)`` of the log likelihood for every weight, in one aggregate.

    The intercept is not penalized.
    """
    error = F.when(F.col(label) == 1, 1.0).otherwise(0.0) - link(affine(columns, weights))
    factors = [F.lit(1.0), *[F.col(c) for c in columns]]
    sums = df.select(error.alias("_e"), *columns).agg(
        F.array(*[F.sum(F.col("_e") * x) for x in factors]).alias("_g")
    )
    shrink = F.array(*[F.lit(0.0 if j == 0 else 2.0 * l2 * w) for j, w in enumerate(weights)])
    derivative = F.zip_with("_g", shrink, lambda g, s: g - s)
    return sums.select(F.posexplode(derivative).alias("idx", "derivative"))


def squared_error_cost(df: DataFrame, columns: Sequence[str], label: str,
                       weights: Sequence[float]) -> DataFrame:
    """Half the sum of squared errors of an affine score, and its mean per row."""
    error = F.col(label) - affine(columns, weights)
    half = F.lit(0.5) * error * error
    return df.agg(F.sum(half).alias("cost"), F.avg(half).alias("mean_cost"))
