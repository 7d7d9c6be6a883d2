"""Queries: counts, evaluation of predictions, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from separatrix.functions.vectors import affine, link, sign_strict
from separatrix.operators import metrics, ranking, tables
from separatrix.plans import fixtures as fx
from separatrix.plans.registry import query, rounded, six

with_sql = fx.with_sql

# Fixed weights over (amount in 100,000, balance in 10,000): a loan classifier to evaluate.
LOAN_WEIGHTS = [0.1, -0.4, 0.9]
_LOAN_CTE = f"""scored AS MATERIALIZED (SELECT *, {LOAN_WEIGHTS[0]}::DOUBLE + {LOAN_WEIGHTS[1]}::DOUBLE * a
        + {LOAN_WEIGHTS[2]}::DOUBLE * b AS s FROM (
        SELECT *, amount / 100000.0::DOUBLE AS a, balance / 10000.0::DOUBLE AS b FROM loan_rows) t),
    judged AS MATERIALIZED (SELECT *, CASE WHEN s > 0 THEN 1 ELSE -1 END AS p FROM scored)"""


def loan_sql(body: str) -> str:
    """``body`` over the judged loans; it may start with further expressions after a comma."""
    return with_sql("loan_rows", f"WITH {_LOAN_CTE}{body if body.startswith(',') else ' ' + body}")


def scored_loans(spark, folder):
    rows = fx.balanced_loans(spark, folder).withColumns(
        {"a": F.col("amount") / F.lit(100000.0), "b": F.col("balance") / F.lit(10000.0)}
    )
    scored = rows.withColumn("score", affine(["a", "b"], LOAN_WEIGHTS))
    return scored.withColumn("predicted", sign_strict("score"))


@query("G1", "SELECT count(*) AS n FROM lineitem")
def row_count(spark, folder):
    return metrics.row_count(spark.read.parquet(f"{folder}/lineitem.parquet"))


@query(
    "G2",
    with_sql(
        "loans",
        """SELECT count(*) FILTER (safe_loans = 1) AS positive, count(*) FILTER (safe_loans = -1) AS negative,
        count(*) FILTER (balance <= 0) AS in_debt FROM loans""",
    ),
)
def conditional_counts(spark, folder):
    return fx.loans(spark, folder).agg(
        metrics.hits(F.col("safe_loans") == 1).alias("positive"),
        metrics.hits(F.col("safe_loans") == -1).alias("negative"),
        metrics.hits(F.col("balance") <= 0).alias("in_debt"),
    )


@query(
    "G4",
    with_sql(
        "even_loans",
        """SELECT safe_loans, n, round(n::DOUBLE / sum(n) OVER (), 6) AS share
        FROM (SELECT safe_loans, count(*) AS n FROM even_loans GROUP BY safe_loans) t""",
    ),
)
def class_balance(spark, folder):
    return rounded(metrics.distribution(fx.balanced_loans(spark, folder), "safe_loans"))


@query(
    "G5",
    with_sql(
        "loans",
        f"""WITH tagged AS MATERIALIZED (SELECT safe_loans, {fx.split_sql('loan_id', 0.8, 1)} AS split FROM loans),
        m AS (SELECT safe_loans AS c FROM tagged WHERE split = 'train' GROUP BY safe_loans
            ORDER BY count(*) DESC, safe_loans LIMIT 1)
        SELECT max(c) AS majority_class, count(*) AS n, count(*) FILTER (safe_loans = c) AS correct,
            round(avg(CASE WHEN safe_loans = c THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy
        FROM tagged, m WHERE split = 'test'""",
    ),
)
def majority_class(spark, folder):
    tagged = fx.random_split(fx.loans(spark, folder), "loan_id", 0.8, 1)
    train, test = tagged.filter("split = 'train'"), tagged.filter("split = 'test'")
    return rounded(metrics.majority_baseline(train, test, "safe_loans"))


@query(
    "G6",
    loan_sql(
        """SELECT split, count(*) FILTER (safe_loans = p) AS correct, count(*) FILTER (safe_loans <> p) AS incorrect,
        count(*) AS total, round(avg(CASE WHEN safe_loans = p THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy
        FROM judged GROUP BY split"""
    ),
)
def accuracy_by_split(spark, folder):
    return rounded(metrics.accuracy(scored_loans(spark, folder), "safe_loans", "predicted", ["split"]))


@query(
    "G7",
    loan_sql(
        """SELECT safe_loans AS target_label, p AS predicted_label, count(*) AS n FROM judged
        GROUP BY safe_loans, p"""
    ),
)
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(scored_loans(spark, folder), "safe_loans", "predicted")


_COUNTS_SQL = """counts AS (SELECT count(*) FILTER (safe_loans = 1 AND p = 1) AS true_pos,
    count(*) FILTER (safe_loans = -1 AND p = 1) AS false_pos, count(*) FILTER (safe_loans = 1 AND p = -1) AS false_neg,
    count(*) FILTER (safe_loans = p) AS correct, count(*) AS total FROM judged)"""


@query("G8", loan_sql(f", {_COUNTS_SQL} SELECT * FROM counts"))
def outcome_counts(spark, folder):
    return metrics.mistakes(scored_loans(spark, folder), "safe_loans", "predicted")


@query(
    "G9",
    loan_sql(
        f""", {_COUNTS_SQL}, r AS (SELECT true_pos::DOUBLE / (true_pos + false_pos) AS precision,
            true_pos::DOUBLE / (true_pos + false_neg) AS recall, correct::DOUBLE / total AS accuracy,
            correct::DOUBLE / (correct + false_neg) AS correct_over_correct_fn FROM counts)
        SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(accuracy, 6) AS accuracy,
            round(correct_over_correct_fn, 6) AS correct_over_correct_fn,
            round(2 * precision * recall / (precision + recall), 6) AS f1,
            round(2 * accuracy * correct_over_correct_fn / (accuracy + correct_over_correct_fn), 6) AS f1_as_written
        FROM r"""
    ),
)
def precision_recall(spark, folder):
    return rounded(metrics.precision_recall(scored_loans(spark, folder), "safe_loans", "predicted"))


@query(
    "G10",
    loan_sql(
        f""", {_COUNTS_SQL} SELECT false_neg, false_pos, 10000.0::DOUBLE * false_neg AS fn_cost,
        20000.0::DOUBLE * false_pos AS fp_cost,
        10000.0::DOUBLE * false_neg + 20000.0::DOUBLE * false_pos AS total_cost FROM counts"""
    ),
)
def mistake_cost(spark, folder):
    return metrics.mistake_cost(scored_loans(spark, folder), "safe_loans", "predicted")


@query(
    "G11",
    with_sql(
        "samples",
        """WITH r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS mid
            FROM samples)
        SELECT round((sum(mid) FILTER (y = 1) - p * (p + 1) / 2.0::DOUBLE) / (p * (n - p)), 6) AS auc
        FROM r, (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (y = 1))::DOUBLE AS p FROM samples) c
        GROUP BY p, n""",
    ),
)
def area_under_roc(spark, folder):
    auc = metrics.area_under_roc(fx.samples(spark, folder), "y", "x")
    return rounded(spark.createDataFrame([(auc,)], "auc double"))


_FLOWER_WEIGHTS = [0.25, -1.5, 0.75]
_FLOWER_SCORE = (
    f"({_FLOWER_WEIGHTS[0]}::DOUBLE + {_FLOWER_WEIGHTS[1]}::DOUBLE * x0 + {_FLOWER_WEIGHTS[2]}::DOUBLE * x1)"
)
_PENALTY = sum(w * w for w in _FLOWER_WEIGHTS[1:])
_TERM = "((CASE WHEN y = 1 THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END) * s - (greatest(-s, 0) + ln(1 + exp(-abs(s)))))"


def _flower_sql(select: str) -> str:
    return with_sql(
        "flowers",
        f"WITH f AS (SELECT y, x0, x1, {_FLOWER_SCORE} AS s FROM flowers) {select}",
    )


@query(
    "G12 G13",
    _flower_sql(
        f"""SELECT 0.0::DOUBLE AS l2, round(sum({_TERM}), 6) AS log_likelihood FROM f
        UNION ALL SELECT 4.0::DOUBLE, round(sum({_TERM}) - 4.0::DOUBLE * {_PENALTY!r}::DOUBLE, 6) FROM f"""
    ),
)
def log_likelihoods(spark, folder):
    flowers = fx.flowers(spark, folder)
    parts = [
        metrics.log_likelihood(flowers, ["x0", "x1"], "y", _FLOWER_WEIGHTS, l2).select(
            F.lit(l2).alias("l2"), "log_likelihood"
        )
        for l2 in (0.0, 4.0)
    ]
    return rounded(parts[0].unionByName(parts[1]))


def _gradient_sql(l2: float) -> str:
    error = "((CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) - 1 / (1 + exp(-s)))"
    shrink = [0.0, *[2 * l2 * w for w in _FLOWER_WEIGHTS[1:]]]
    return " UNION ALL ".join(
        f"SELECT {l2}::DOUBLE AS l2, {j} AS idx, round(sum({error} * {x}) - {shrink[j]!r}::DOUBLE, 6) AS derivative FROM f"
        for j, x in enumerate(["1.0::DOUBLE", "x0", "x1"])
    )


@query("G14 G15", _flower_sql(f"{_gradient_sql(0.0)} UNION ALL {_gradient_sql(4.0)}"))
def gradients(spark, folder):
    flowers = fx.flowers(spark, folder)
    parts = [
        metrics.gradient(flowers, ["x0", "x1"], "y", _FLOWER_WEIGHTS, l2).select(F.lit(l2).alias("l2"), "idx", "derivative")
        for l2 in (0.0, 4.0)
    ]
    return rounded(parts[0].unionByName(parts[1]))


@query(
    "G16",
    _flower_sql("SELECT round(sum((y - s) ** 2) / 2, 6) AS cost, round(avg((y - s) ** 2) / 2, 6) AS mean_cost FROM f"),
)
def squared_error(spark, folder):
    return rounded(metrics.squared_error_cost(fx.flowers(spark, folder), ["x0", "x1"], "y", _FLOWER_WEIGHTS))


@query(
    "G17",
    with_sql(
        "flowers",
        """SELECT round(min(x0) - 1, 6) AS x0_lo, round(max(x0) + 1, 6) AS x0_hi,
        round(min(x1) - 1, 6) AS x1_lo, round(max(x1) + 1, 6) AS x1_hi FROM flowers""",
    ),
)
def plane_extents(spark, folder):
    return rounded(tables.extents(fx.flowers(spark, folder), ["x0", "x1"]))


@query("H1", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def sorted_rows(spark, folder):
    customers = fx.table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return ranking.sort_desc(customers, "c_acctbal", "c_custkey")


_TOP_SQL = "SELECT loan_id, round(1 / (1 + exp(-s)), 6) AS probability FROM scored ORDER BY s {0}, loan_id LIMIT 20"


def _extreme(spark, folder, reverse):
    scored = scored_loans(spark, folder).select("loan_id", "score")
    best = ranking.top_k(scored, "score", 20, "loan_id", reverse)
    return best.select("loan_id", six(link("score")).alias("probability"))


@query("H2", loan_sql(_TOP_SQL.format("DESC")))
def most_probable(spark, folder):
    return _extreme(spark, folder, reverse=False)


@query("H3", loan_sql(_TOP_SQL.format("ASC")))
def least_probable(spark, folder):
    return _extreme(spark, folder, reverse=True)
