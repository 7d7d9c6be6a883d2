"""Queries: predictions of trained models and comparisons between models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from separatrix.functions.vectors import link, sign_strict
from separatrix.operators import estimators, grids, logistic, metrics, mixed_trees, neighbours, ranking, wide_words
from separatrix.operators.models import LinearModel, weight_signs
from separatrix.plans import fixtures as fx
from separatrix.plans import learning as ln
from separatrix.plans.registry import query, rounded, six
from separatrix.storage import materialize

with_sql = fx.with_sql

# Scores of every review under every penalty.
_SCORES_SQL = """scores AS MATERIALIZED (SELECT w.l2, x.doc_id, any_value(d.sentiment) AS sentiment,
    any_value(d.split) AS split, sum(w.value * x.v) AS s FROM x JOIN w ON w.idx = x.idx
    JOIN docs d ON d.doc_id = x.doc_id GROUP BY w.l2, x.doc_id)"""


def _margins(spark, folder, penalties):
    _, matrix, path = ln.train_path(spark, folder, tuple(penalties))
    named = {f"s_{k}": path.weights[k].tolist() for k in range(len(penalties))}
    return path, logistic.with_margins(matrix, "features", named)


@query(
    "J1 J2 J3",
    ln.path_sql(
        f""", {_SCORES_SQL} SELECT doc_id, round(s, 6) + 0.0::DOUBLE AS margin,
        round(CASE WHEN s >= 0 THEN 1 / (1 + exp(-s)) ELSE exp(s) / (1 + exp(s)) END, 6) AS probability,
        CASE WHEN s > 0 THEN 1 ELSE -1 END AS predicted FROM scores""",
        [0.0],
    ),
)
def review_predictions(spark, folder):
    _, scored = _margins(spark, folder, [0.0])
    return scored.select(
        "doc_id",
        six(F.col("s_0")).alias("margin"),
        six(link("s_0")).alias("probability"),
        sign_strict("s_0").alias("predicted"),
    )


@query(
    "J5",
    ln.path_sql(
        """SELECT count(*) FILTER (value >= 0) AS non_negative, count(*) FILTER (value < 0) AS negative,
        count(*) AS total FROM w""",
        [0.0],
    ),
)
def weight_sign_counts(spark, folder):
    _, _, path = ln.train_path(spark, folder, (0.0,))
    return weight_signs(path.coefficients(spark))


GRID_WEIGHTS = [0.25, -1.5, 0.75]


def _grid_sql(body: str) -> str:
    return with_sql(
        "quadrants",
        f"""WITH box AS (SELECT min(x0) - 1 AS xl, max(x0) + 1 AS xh, min(x1) - 1 AS yl, max(x1) + 1 AS yh FROM quadrants),
        dims AS (SELECT xl, yl, ceil((xh - xl) / 0.02::DOUBLE)::BIGINT AS nx, ceil((yh - yl) / 0.02::DOUBLE)::BIGINT AS ny
            FROM box),
        cells AS MATERIALIZED (SELECT i + nx * j AS cell, xl + i * 0.02::DOUBLE AS x0, yl + j * 0.02::DOUBLE AS x1
            FROM dims, LATERAL (SELECT unnest(range(nx)) AS i) a, LATERAL (SELECT unnest(range(ny)) AS j) b)
        {body}""",
    )


@query(
    "J6",
    _grid_sql(
        f"""SELECT cell, round(x0, 6) + 0.0::DOUBLE AS x0, round(x1, 6) + 0.0::DOUBLE AS x1,
        CASE WHEN {GRID_WEIGHTS[0]}::DOUBLE + {GRID_WEIGHTS[1]}::DOUBLE * x0 + {GRID_WEIGHTS[2]}::DOUBLE * x1 >= 0
            THEN 1 ELSE -1 END AS predicted FROM cells"""
    ),
)
def decision_grid(spark, folder):
    """Class of a linear model at every grid point around the data."""
    model = LinearModel(["x0", "x1"], GRID_WEIGHTS)
    cells = grids.grid(fx.quadrants(spark, folder), "x0", "x1")
    return rounded(cells.withColumn("predicted", model.predict()))


@query(
    "J6 I14",
    _grid_sql(
        """, near AS (SELECT c.cell, q.label, row_number() OVER (PARTITION BY c.cell
            ORDER BY sqrt((c.x0 - q.x0) ** 2 + (c.x1 - q.x1) ** 2), q.point_id) AS rank FROM cells c, quadrants q),
        votes AS (SELECT cell, label, count(*) AS n FROM near WHERE rank <= 3 GROUP BY cell, label)
        SELECT cell, label AS predicted FROM votes
        QUALIFY row_number() OVER (PARTITION BY cell ORDER BY n DESC, label) = 1"""
    ),
)
def neighbour_grid(spark, folder):
    """Class of 3 nearest neighbours at every grid point around the data."""
    points = fx.quadrants(spark, folder)
    cells = grids.grid(points, "x0", "x1")
    train = points.select(F.col("point_id").alias("id"), "label", F.array("x0", "x1").alias("x"))
    predicted = neighbours.classify(train, cells.select(F.col("cell").alias("qid"), F.array("x0", "x1").alias("x")), 3)
    return predicted.select(F.col("qid").alias("cell"), F.col("prediction").alias("predicted"))


_ACCURACY = "avg(CASE WHEN (s > 0) = (sentiment = 1) THEN 1.0::DOUBLE ELSE 0.0 END)"


@query(
    "J9",
    ln.path_sql(
        f""", {_SCORES_SQL} SELECT l2, round({_ACCURACY} FILTER (split = 'train'), 6) AS train_accuracy,
        round({_ACCURACY} FILTER (split = 'test'), 6) AS validation_accuracy FROM scores GROUP BY l2"""
    ),
)
def penalty_report(spark, folder):
    return rounded(_penalty_report(spark, folder))


def _penalty_report(spark, folder):
    path, scored = _margins(spark, folder, ln.PENALTIES)
    columns = []
    for k in range(len(path.penalties)):
        right = F.when(sign_strict(f"s_{k}") == F.col("sentiment"), 1.0).otherwise(0.0)
        for split, name in (("train", "train_accuracy"), ("test", "validation_accuracy")):
            columns.append(F.avg(F.when(F.col("split") == split, right)).alias(f"{name}_{k}"))
    wide = scored.agg(*columns)
    rows = F.array(
        *[
            F.struct(
                F.lit(p).alias("l2"),
                F.col(f"train_accuracy_{k}").alias("train_accuracy"),
                F.col(f"validation_accuracy_{k}").alias("validation_accuracy"),
            )
            for k, p in enumerate(path.penalties)
        ]
    )
    return wide.select(F.inline(rows))


@query(
    "H5",
    ln.path_sql(
        f""", {_SCORES_SQL} SELECT l2, round({_ACCURACY} FILTER (split = 'train'), 6) AS train_accuracy,
        round({_ACCURACY} FILTER (split = 'test'), 6) AS validation_accuracy FROM scores GROUP BY l2
        ORDER BY validation_accuracy DESC, l2 LIMIT 1"""
    ),
)
def best_penalty(spark, folder):
    return ranking.best_penalty(rounded(_penalty_report(spark, folder)))


@query(
    "J7",
    ln.path_sql(
        f""", {_SCORES_SQL},
        few AS MATERIALIZED (SELECT w.l2, x.doc_id, any_value(d.sentiment) AS sentiment, any_value(d.split) AS split,
            sum(w.value * x.v) AS s FROM x JOIN w ON w.idx = x.idx JOIN docs d ON d.doc_id = x.doc_id
            WHERE x.idx <= 5 GROUP BY w.l2, x.doc_id),
        models AS (SELECT 'all words' AS model, * FROM scores UNION ALL SELECT 'five words', * FROM few)
        SELECT model, split, count(*) FILTER ((s > 0) = (sentiment = 1)) AS correct,
            count(*) FILTER ((s > 0) <> (sentiment = 1)) AS incorrect, count(*) AS total,
            round({_ACCURACY}, 6) AS accuracy FROM models GROUP BY model, split""",
        [0.0],
    ),
)
def model_comparison(spark, folder):
    """Accuracy of a model with all its words and with the first five only, on both parts."""
    _, matrix, path = ln.train_path(spark, folder, (0.0,))
    full = path.weights[0].tolist()
    few = full[:6] + [0.0] * (len(full) - 6)
    scored = logistic.with_margins(matrix, "features", {"all words": full, "five words": few})
    models = F.array(
        *[
            F.struct(F.lit(m).alias("model"), sign_strict(m).alias("predicted"))
            for m in ("all words", "five words")
        ]
    )
    long = scored.select("sentiment", "split", F.inline(models))
    return rounded(metrics.accuracy(long, "sentiment", "predicted", ["model", "split"]))


def _depth_sql(depth: int) -> str:
    return f"""SELECT {depth} AS depth, split, round(avg(CASE WHEN prediction_class = safe_loans THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy,
        (SELECT round((sum(r) FILTER (safe_loans = 1) - count(*) FILTER (safe_loans = 1) * (count(*) FILTER (safe_loans = 1) + 1) / 2.0::DOUBLE)
            / (count(*) FILTER (safe_loans = 1) * count(*) FILTER (safe_loans <> 1)), 6) FROM (
            SELECT safe_loans, rank() OVER (ORDER BY probability_pos) + (count(*) OVER (PARTITION BY probability_pos) - 1) / 2.0::DOUBLE AS r
            FROM {ln.scored_sql(depth)} t WHERE split = 'train') ranked) AS training_auc
        FROM {ln.scored_sql(depth)} t GROUP BY split"""


@query("J8 I15", ln.mixed_tree_sql(" UNION ALL ".join(_depth_sql(d) for d in (2, 6, 10)), 10))
def depth_comparison(spark, folder):
    """Accuracy on both parts and training AUC of trees of depth 2, 6 and 10.

    A tree grown level by level holds the shallower ones.
    """
    rows = materialize(fx.balanced_loans(spark, folder), "balanced-loans")
    train = rows.filter("split = 'train'")
    tree = mixed_trees.grow(train, ln.CATEGORICAL, ln.NUMERIC, "safe_loans", 10)
    reports = []
    for depth in (2, 6, 10):
        scored = materialize(mixed_trees.with_outputs(rows, train, tree, "safe_loans", depth).select("split", "safe_loans", "probability_pos", "prediction_class"), "scored-loans")
        auc = metrics.area_under_roc(scored.filter("split = 'train'"), "safe_loans", "probability_pos")
        figures = metrics.accuracy(scored, "safe_loans", "prediction_class", ["split"]).collect()
        reports += [(depth, r["split"], r["accuracy"], auc) for r in figures]
    return rounded(spark.createDataFrame(reports, "depth int, split string, accuracy double, training_auc double"))


@query("J4 J7 I10")
def word_model_comparison(spark, folder):
    """The all-words classifier and the one on given words, on both parts."""
    rows = ln._tagged_tokens(spark, folder)
    train = rows.filter("split = 'train'")
    parts = []
    for name, words in (("all words", None), ("given words", fx.review_words(spark, folder))):
        if words is None:
            model = estimators.all_word_logistic(train, "t", "sentiment")
        else:
            model = estimators.word_logistic(train, "t", "sentiment", words)
        wide = isinstance(model, wide_words.WideWordModel)
        scored = (model.with_outputs(rows, "t") if wide else estimators.with_outputs(model, rows)).withColumn("model", F.lit(name))
        parts.append(metrics.accuracy(scored, "sentiment", "prediction_class", ["model", "split"]))
    return reduce(lambda a, b: a.unionByName(b), parts)
