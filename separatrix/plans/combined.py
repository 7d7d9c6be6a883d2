"""Queries: fitted models carried through to mistakes, cost and ranked rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from separatrix.functions.vectors import sign_strict
from separatrix.operators import metrics, ranking, trees
from separatrix.plans import fixtures as fx
from separatrix.plans import inspection as ins
from separatrix.plans import learning as ln
from separatrix.plans.registry import query, rounded, six

_TEST_SQL = ",\n".join(
    [
        "test_0 AS MATERIALIZED (SELECT *, 1 AS node FROM loan_rows WHERE split = 'test')",
        ln._descend_sql("test_0", "split_0", "test_1"),
        ln._descend_sql("test_1", "split_1", "test_2"),
    ]
)


@query(
    "I16 J10 G8 G9 G10",
    fx.with_sql(
        "loan_rows",
        f"""WITH {ln.TREE_SQL}, {ln._descend_sql('level_1', 'split_1', 'level_2')}, {_TEST_SQL},
        leaf AS (SELECT node, CASE WHEN avg(CASE WHEN safe_loans = 1 THEN 1.0::DOUBLE ELSE 0.0 END) > 0.5 THEN 1 ELSE -1 END AS p
            FROM level_2 GROUP BY node),
        c AS (SELECT count(*) FILTER (safe_loans = 1 AND p = 1) AS true_pos, count(*) FILTER (safe_loans = -1 AND p = 1) AS false_pos,
            count(*) FILTER (safe_loans = 1 AND p = -1) AS false_neg, count(*) FILTER (safe_loans = p) AS correct, count(*) AS total
            FROM test_2 JOIN leaf USING (node))
        SELECT *, 10000.0::DOUBLE * false_neg + 20000.0::DOUBLE * false_pos AS total_cost,
            round(true_pos::DOUBLE / (true_pos + false_pos), 6) AS precision,
            round(true_pos::DOUBLE / (true_pos + false_neg), 6) AS recall FROM c""",
    ),
)
def tree_mistakes(spark, folder):
    """A tree of depth 2, grown on the training loans: its mistakes on the others, and what they cost."""
    rows = fx.balanced_loans(spark, folder)
    train = rows.filter("split = 'train'")
    tree = trees.grow(train, ln.TREE_FEATURES, "safe_loans", 2)
    # As many rows as the tree has leaves.
    classes = trees.leaves(train, tree, "safe_loans").select("leaf", F.when(F.col("probability") > 0.5, 1).otherwise(-1).alias("predicted"))
    judged = rows.filter("split = 'test'").withColumn("leaf", tree.leaf()).join(classes, "leaf")
    counts = metrics.mistakes(judged, "safe_loans", "predicted")
    true_pos = F.col("true_pos").cast("double")
    return rounded(
        counts.select(
            "*",
            (F.lit(metrics.FN_COST) * F.col("false_neg") + F.lit(metrics.FP_COST) * F.col("false_pos")).alias("total_cost"),
            F.try_divide(true_pos, F.col("true_pos") + F.col("false_pos")).alias("precision"),
            F.try_divide(true_pos, F.col("true_pos") + F.col("false_neg")).alias("recall"),
        )
    )


@query(
    "J7 G7",
    ln.path_sql(
        f""", {ins._SCORES_SQL} SELECT split, sentiment AS target_label, CASE WHEN s > 0 THEN 1 ELSE -1 END AS predicted_label,
        count(*) AS n FROM scores GROUP BY split, sentiment, predicted_label""",
        [0.0],
    ),
)
def review_confusion(spark, folder):
    """Confusion matrix of the fitted review model on both parts."""
    _, scored = ins._margins(spark, folder, [0.0])
    judged = scored.withColumn("predicted", sign_strict("s_0"))
    return judged.groupBy("split", F.col("sentiment").alias("target_label"), F.col("predicted").alias("predicted_label")).agg(
        F.count("*").alias("n")
    )


@query(
    "H2 H3 J7",
    ln.path_sql(
        f""", {ins._SCORES_SQL}, t AS (SELECT doc_id, sentiment, round(s, 9) + 0.0::DOUBLE AS margin FROM scores WHERE split = 'test')
        SELECT doc_id, sentiment, direction, round(margin, 6) + 0.0::DOUBLE AS margin FROM (
            (SELECT *, 'positive' AS direction FROM t ORDER BY margin DESC, doc_id LIMIT 20)
            UNION ALL (SELECT *, 'negative' FROM t ORDER BY margin, doc_id LIMIT 20)) e""",
        [0.0],
    ),
)
def extreme_reviews(spark, folder):
    """The 20 test reviews that the fitted model finds most positive, and most negative."""
    _, scored = ins._margins(spark, folder, [0.0])
    test = scored.filter("split = 'test'").select("doc_id", "sentiment", (F.round("s_0", 9) + F.lit(0.0)).alias("margin"))
    positive = ranking.top_k(test, "margin", 20, "doc_id").withColumn("direction", F.lit("positive"))
    negative = ranking.top_k(test, "margin", 20, "doc_id", reverse=True).withColumn("direction", F.lit("negative"))
    return positive.unionByName(negative).withColumn("margin", six(F.col("margin")))
