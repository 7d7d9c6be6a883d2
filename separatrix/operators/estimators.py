"""Library classifiers: Spark ML estimators set up as the learners they stand for."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
)
from pyspark.ml.feature import CountVectorizerModel, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from separatrix.functions.vectors import affine
from separatrix.operators.models import coefficient_frame
from separatrix.operators.wide_words import WideWordModel, fit_all_words


# Words a dense weight vector may have; their list goes through the driver. ``wide_words``
# fits more of them, as a table.
MOST_WORDS = 500_000


def binary_label(label: str) -> Column:
    """Labels -1 and +1 as the 0.0 and 1.0 that Spark ML expects."""
    return F.when(F.col(label) == 1, 1.0).otherwise(0.0)


def _vocabulary(train: DataFrame, tokens: str) -> list[str] | None:
    """All words by document frequency, then word; none if they are more than ``MOST_WORDS``."""
    each = train.select(F.explode(F.array_distinct(tokens)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    each = each.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if each.count() > MOST_WORDS:
            return None
        return [r["word"] for r in each.orderBy(F.desc("df"), "word").select("word").collect()]
    finally:
        each.unpersist()


def all_word_logistic(train: DataFrame, tokens: str, label: str, penalty: float = 0.01, max_iter: int = 10) -> PipelineModel | WideWordModel:
    """``word_logistic`` on all words, however many: beyond ``MOST_WORDS`` by ``wide_words``, with the same weights."""
    words = _vocabulary(train, tokens)
    if words is not None:
        return word_logistic(train, tokens, label, words, penalty, max_iter)
    return fit_all_words(train, tokens, binary_label(label), penalty, max_iter)


def word_logistic(train: DataFrame, tokens: str, label: str, words: Sequence[str] | None = None,
                  penalty: float = 0.01, max_iter: int = 10) -> PipelineModel:
    """Logistic classifier on word counts: of all words, or of the given ones.

    All words means all: they are ordered by document frequency, then by word. Weights are
    dense, so more than ``MOST_WORDS`` of them are an error and not a shorter list.
    """
    n = max(1, train.count())
    if words is None:
        words = _vocabulary(train, tokens)
        if words is None:
            raise ValueError(f"more than {MOST_WORDS} words; give the words to use, or fit a table of weights")
    counter = CountVectorizerModel.from_vocabulary(list(words), tokens, "features")
    learner = LogisticRegression(
        featuresCol="features", labelCol="_label", regParam=penalty / n, maxIter=max_iter
    )
    return Pipeline(stages=[counter, learner]).fit(train.withColumn("_label", binary_label(label)))


def word_coefficients(spark: SparkSession, model: PipelineModel | WideWordModel) -> DataFrame:
    """``(idx, name, value)`` of a word model, intercept first."""
    if isinstance(model, WideWordModel):
        return model.coefficients()
    counter, learner = model.stages
    return coefficient_frame(spark, counter.vocabulary, [learner.intercept, *learner.coefficients])


def with_outputs(model, df: DataFrame) -> DataFrame:
    """Add ``margin``, ``probability_pos`` and ``prediction_class`` of a binary model."""
    scored = model.transform(df)
    return scored.withColumns(
        {
            "margin": vector_to_array("rawPrediction")[1],
            "probability_pos": vector_to_array("probability")[1],
            "prediction_class": F.when(F.col("prediction") == 1.0, 1).otherwise(-1),
        }
    ).drop("rawPrediction", "probability", "prediction")


def _assembled(columns: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol="features")


def logistic(train: DataFrame, columns: Sequence[str], label: str, c: float = 1000.0) -> PipelineModel:
    """Logistic regression with inverse penalty ``c``; several classes become multinomial."""
    learner = LogisticRegression(
        labelCol=label, regParam=1.0 / (c * max(1, train.count())), standardization=False
    )
    return Pipeline(stages=[_assembled(columns), learner]).fit(train)


def linear_svm(train: DataFrame, columns: Sequence[str], label: str, c: float = 1.0,
               many_classes: bool = False, max_iter: int = 100) -> PipelineModel:
    """Linear support vector machine; more than two classes are fitted one against the rest."""
    penalty = 1.0 / (c * max(1, train.count()))
    learner = LinearSVC(labelCol=label, regParam=penalty, standardization=False, maxIter=max_iter)
    if many_classes:
        learner = OneVsRest(classifier=learner, labelCol=label, parallelism=4)
    return Pipeline(stages=[_assembled(columns), learner]).fit(train)


def fourier_projection(dims: int, gamma: float, width: int, seed: int) -> np.ndarray:
    """Rows ``[b, w1, ..., wd]`` of random Fourier features of a Gaussian kernel."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0 * gamma), (width, dims))
    b = rng.uniform(0.0, 2.0 * np.pi, width)
    return np.column_stack([b, w])


def fourier_features(columns: Sequence[str], projection: np.ndarray) -> Column:
    """Array of ``sqrt(2/D) cos(w . x + b)`` (Rahimi, Recht 2007)."""
    scale = F.lit(float(np.sqrt(2.0 / len(projection))))
    return F.array(*[scale * F.cos(affine(columns, row)) for row in projection])


def rbf_svm(train: DataFrame, columns: Sequence[str], label: str, gamma: float = 0.1, c: float = 10.0,
            width: int = 100, seed: int = 0, max_iter: int = 100):
    """Support vector machine with an approximate Gaussian kernel.

    Returns the fitted model and a function that adds its features to a table.
    """
    projection = fourier_projection(len(columns), gamma, width, seed)

    def mapped(df: DataFrame) -> DataFrame:
        return df.withColumn("features", array_to_vector(fourier_features(columns, projection)))

    penalty = 1.0 / (c * max(1, train.count()))
    learner = LinearSVC(labelCol=label, regParam=penalty, standardization=False, maxIter=max_iter)
    return learner.fit(mapped(train)), mapped


def decision_tree(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str], label: str,
                  max_depth: int = 6, seed: int = 1) -> PipelineModel:
    """Decision tree on categorical and numeric columns; unseen categories are kept."""
    inputs, bins = tree_inputs(train, categorical, numeric)
    rows = inputs.transform(train).select("features", label)
    return PipelineModel([*inputs.stages, fit_tree(rows, label, bins, max_depth, seed)])


def fit_tree(rows: DataFrame, label: str, bins: int, max_depth: int = 6, seed: int = 1):
    """Decision tree on assembled ``features``."""
    learner = DecisionTreeClassifier(labelCol="_label", maxDepth=max_depth, maxBins=bins, seed=seed)
    return learner.fit(rows.select("features", binary_label(label).alias("_label")))


def tree_inputs(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> tuple[PipelineModel, int]:
    """Indexer and assembler for trees, and the number of bins that categories need.

    Trees of several depths can share them and the table they make.
    """
    indexed = [f"{c}_idx" for c in categorical]
    used = train.select(*categorical, *numeric).persist(StorageLevel.MEMORY_AND_DISK)
    distinct = used.agg(*[F.approx_count_distinct(c).alias(c) for c in categorical]).first()
    # Room for the estimate's error and for the extra category of unseen values.
    most = max(distinct, default=0)
    bins = max(32, int(most * 1.2) + 2)
    stages = [
        StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"),
        VectorAssembler(inputCols=[*indexed, *numeric], outputCol="features"),
    ]
    try:
        return Pipeline(stages=stages).fit(used), bins
    finally:
        used.unpersist()
