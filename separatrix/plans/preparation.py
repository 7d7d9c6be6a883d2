"""Queries: loading, projection, filters, sampling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from separatrix.operators import sampling, tables
from separatrix.operators.metrics import row_count
from separatrix.plans import fixtures as fx
from separatrix.plans.registry import query, rounded
from separatrix.sources.readers import load_table, read_positional_csv, read_word_list
from separatrix.storage import fresh_path

with_sql = fx.with_sql


@query("A1", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def stored_table(spark, folder):
    orders = load_table(spark, f"{folder}/orders.parquet", fx.SCHEMAS["orders"])
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("A2", "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def positional_csv(spark, folder):
    """Customers written as CSV without a header, read back by position."""
    path = fresh_path(spark, "customers-csv")
    customers = fx.table(spark, folder, "customer")
    customers.select("c_custkey", "c_acctbal", "c_mktsegment").write.csv(path, header=False)
    return read_positional_csv(spark, path, "id long, balance double, segment string")


@query("A3", with_sql("vocab", "SELECT idx - 1 AS idx, word FROM vocab"))
def json_word_list(spark, folder):
    """The frequent words of the reviews as one JSON array, read back in order."""
    path = fresh_path(spark, "words-json")
    words = fx.review_words(spark, folder)
    line = F.to_json(F.array(*[F.lit(w) for w in words]))
    spark.range(1).select(line.alias("value")).write.text(path)
    return read_word_list(spark, path)


@query(
    "A4",
    with_sql("vocab", "SELECT 0 AS idx, '(intercept)' AS word UNION ALL SELECT idx, word FROM vocab"),
)
def coefficient_words(spark, folder):
    return tables.coefficient_words(spark, fx.review_words(spark, folder))


@query("A5 F12", with_sql("quadrants", "SELECT point_id, round(x0, 6) AS x0, round(x1, 6) AS x1, label FROM quadrants"))
def xor_labels(spark, folder):
    return rounded(fx.quadrants(spark, folder))


@query("A6", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 10")
def first_rows(spark, folder):
    customers = fx.table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    return tables.preview(customers, "c_custkey", 10)


@query("B1", with_sql("loans", "SELECT loan_id, grade, amount, safe_loans FROM loans"))
def chosen_columns(spark, folder):
    return fx.loans(spark, folder).select("loan_id", "grade", "amount", "safe_loans")


@query("B2 B4", with_sql("opinions", "SELECT doc_id, rating, sentiment FROM opinions"))
def sentiment_from_rating(spark, folder):
    return fx.opinions(spark, folder)


@query("B3", with_sql("loans", "SELECT loan_id, bad_loans, safe_loans FROM loans"))
def safe_from_flag(spark, folder):
    return fx.loans(spark, folder).select("loan_id", "bad_loans", "safe_loans")


@query("B4", with_sql("reviews", "SELECT count(*) AS n FROM reviews WHERE rating <> 3"))
def without_neutral(spark, folder):
    return row_count(tables.drop_neutral(fx.ratings(spark, folder)))


@query("B5", with_sql("loans", "SELECT loan_id, amount FROM loans WHERE safe_loans = -1 AND amount >= 250000"))
def large_risky_loans(spark, folder):
    loans = fx.loans(spark, folder)
    return loans.filter((F.col("safe_loans") == -1) & (F.col("amount") >= 250000)).select("loan_id", "amount")


@query("B6", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def rows_in_list(spark, folder):
    orders = fx.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return tables.filter_by(orders, "o_orderpriority", ["1-URGENT", "5-LOW"])


@query("B6", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def rows_in_table(spark, folder):
    toxic = fx.table(spark, folder, "labels").filter("toxic = 1").select("doc_id")
    return tables.filter_by(fx.table(spark, folder, "documents").select("doc_id", "lang"), "doc_id", toxic)


@query("B7", with_sql("loans", "SELECT * EXCLUDE (bad_loans, amount) FROM loans"))
def dropped_columns(spark, folder):
    return fx.loans(spark, folder).drop("bad_loans", "amount")


@query("B8", with_sql("flowers", "SELECT 1.0::DOUBLE AS intercept, flower_id, round(x0, 6) AS x0 FROM flowers"))
def constant_column(spark, folder):
    return rounded(tables.with_intercept(fx.flowers(spark, folder).select("flower_id", "x0")))


@query("B9", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 3 OFFSET 10")
def rows_by_position(spark, folder):
    customers = fx.table(spark, folder, "customer").select("c_custkey", "c_name")
    return tables.row_slice(customers, "c_custkey", 10, 13)


@query("B10", "SELECT count(*) AS rows, 6 AS cols, count(*) * 6 AS size FROM orders")
def table_shape(spark, folder):
    return tables.shape(fx.table(spark, folder, "orders"))


@query(
    "B10",
    "SELECT (ordinal_position - 1)::INTEGER AS position, column_name, (SELECT count(*) FROM orders) AS rows FROM (SELECT row_number() OVER () AS "
    "ordinal_position, column_name FROM (DESCRIBE SELECT * FROM orders))",
)
def table_columns(spark, folder):
    """The column names of a table next to its number of rows."""
    orders = fx.table(spark, folder, "orders")
    rows = tables.shape(orders).select("rows").scalar()
    return tables.column_names(orders).withColumn("rows", rows)


@query("B11", "SELECT DISTINCT label FROM embeddings")
def label_classes(spark, folder):
    return tables.classes(fx.table(spark, folder, "embeddings"), "label")


@query(
    "B12",
    with_sql(
        "flowers",
        "SELECT flower_id, y AS label, 1.0::DOUBLE AS f0, round(x0, 6) AS f1, round(x1, 6) AS f2 FROM flowers",
    ),
)
def feature_rows(spark, folder):
    rows = tables.assemble(fx.flowers(spark, folder), "flower_id", ["x0", "x1"], "y")
    parts = [F.get("features", F.lit(j)).alias(f"f{j}") for j in range(3)]
    return rounded(rows.select("flower_id", "label", *parts))


@query(
    "C1",
    with_sql(
        "loans",
        "SELECT loan_id, safe_loans FROM loans WHERE safe_loans = -1 UNION ALL "
        "SELECT loan_id, safe_loans FROM loans WHERE amount > 400000",
    ),
)
def appended_rows(spark, folder):
    loans = fx.loans(spark, folder)
    both = tables.append(loans.filter("safe_loans = -1"), loans.filter("amount > 400000"))
    return both.select("loan_id", "safe_loans")


@query(
    "D1",
    f"SELECT doc_id, {fx.split_sql('doc_id', 0.8, 1)} AS split FROM documents",
)
def train_test_split(spark, folder):
    keys = fx.table(spark, folder, "documents").select("doc_id")
    return sampling.random_split(keys, "doc_id", 0.8, 1)


@query("D2", f"SELECT event_id, value FROM events WHERE {fx.uniform_sql('event_id', 1)} < 0.25::DOUBLE")
def sampled_rows(spark, folder):
    events = fx.table(spark, folder, "events").select("event_id", "value")
    return sampling.sample(events, "event_id", 0.25, 1)


@query("D3", with_sql("even_loans", "SELECT loan_id, safe_loans FROM even_loans"))
def balanced_classes(spark, folder):
    loans = fx.loans(spark, folder)
    even = sampling.balance_classes(loans, "loan_id", "safe_loans", fx.BALANCE_SEED)
    return even.select("loan_id", "safe_loans")


@query(
    "D4",
    """
    SELECT event_id, CASE WHEN position <= ceil(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split
    FROM (SELECT event_id, count(*) OVER () AS n,
        row_number() OVER (ORDER BY md5(concat_ws(':', event_id::VARCHAR, '0')), event_id) AS position
        FROM events) t""",
)
def exact_size_split(spark, folder):
    return sampling.exact_split(fx.table(spark, folder, "events").select("event_id"), "event_id", 0.3, 0)


@query(
    "D5",
    """
    SELECT event_id, row_number() OVER (ORDER BY md5(concat_ws(':', event_id::VARCHAR, '1', '3')), event_id)
        AS position FROM events""",
)
def epoch_permutation(spark, folder):
    return sampling.shuffle_order(fx.table(spark, folder, "events").select("event_id"), "event_id", 1, 3)
