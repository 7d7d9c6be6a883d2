"""URL filters: listed rules first, a logistic regression on hashed n-grams for the rest."""

from __future__ import annotations

from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Rule (host, path) and its verdict.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

# Words of the small labelled table; every word is put into each form of host and path.
UNWANTED = (
    "casino", "casino-win", "bet-now", "jackpot", "cheap-pills", "pharma-deal", "no-rx", "spam-farm", "link-farm",
    "free-money", "free-spins", "sports-bets", "fast-loan", "crypto-profit", "adult-cams", "xxx-video", "replica-watch", "click-bait",
)
WANTED = (
    "news", "library", "museum", "school", "weather", "recipes", "garden", "physics", "travel-notes", "history",
    "city-council", "open-data", "music-review", "free-software", "alphabet", "bookshop", "the-harbour", "northern-theatre",
)
HOSTS = ("{}.example.com", "www.{}.example.net", "blog.{}.example.org", "m.{}.example.net")
PATHS = ("/en/12", "/fr/345.html", "/de/67/", "/es/8")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path. Both are '' for a null or an address without ``://``.

    Only A to Z are lower-cased, and nothing but ``/``, ``?``, ``#`` ends a host.
    """
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), CAPITALS, CAPITALS.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as ``struct<rule, verdict>``; null if none does.

    A rule is ``host/path``. It fits its host and all subdomains if the path starts with the
    rule's. The list is part of the plan, so it should stay short.
    """
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    fits = []
    for rule, verdict in rules:
        domain, _, start = rule.partition("/")
        same = (host == domain) | F.endswith(host, F.lit("." + domain))
        held = F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(same & F.startswith(path, F.lit("/" + start)), held))
    best = F.array_max(F.array(*fits))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: ``url`` and ``unwanted`` (0 or 1), a few hundred rows."""
    rows = [
        (f"https://{host.format(word)}{path}", label)
        for label, words in ((1.0, UNWANTED), (0.0, WANTED))
        for word, host, path in product(words, HOSTS, PATHS)
    ]
    return spark.createDataFrame(rows, "url string, unwanted double")


def with_grams(urls: DataFrame, url: str, size: int) -> DataFrame:
    """``__grams``: character n-grams of host and of path, marked by where they come from."""
    host, path = parts(F.col(url))

    def grams(text: Column, mark: str) -> Column:
        # Splitting once keeps long addresses linear.
        letters = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        starts = F.sequence(F.lit(0), F.greatest(F.size(letters) - size, F.lit(0)))
        gram = F.transform(starts, lambda i: F.concat(F.lit(mark), F.array_join(F.slice(letters, i + 1, size), "")))
        return F.when(text == "", F.array().cast("array<string>")).otherwise(gram)

    return urls.withColumn("__grams", F.concat(grams(host, "h"), grams(path, "p")))


def train(
    labelled: DataFrame, url: str = "url", label: str = "unwanted", size: int = 4, buckets: int = 1 << 18, penalty: float = 1e-3
) -> PipelineModel:
    """Logistic regression on hashed ``size``-grams.

    The table is small by contract; rows without a label are left out, and a table
    without rows is an error.
    """
    rows = with_grams(labelled.filter(F.col(label).isNotNull()), url, size)
    counts = HashingTF(inputCol="__grams", outputCol="__features", numFeatures=buckets, binary=True)
    model = LogisticRegression(featuresCol="__features", labelCol=label, predictionCol="__predicted", rawPredictionCol="__raw",
                               probabilityCol="__probability", regParam=penalty, maxIter=60, standardization=False)
    return Pipeline(stages=[counts, model]).fit(rows)


def judge(
    urls: DataFrame, model: PipelineModel, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, size: int = 4, threshold: float = 0.5
) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule``, ``score`` and ``verdict``.

    ``score`` is the model's probability of an unwanted address; it decides where no rule
    fits. An address without host and path has no n-grams and is scored by the intercept.
    Columns of ``urls`` with the names of new ones are replaced. Rows are never dropped.
    """
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "score", "verdict") or c == url]
    host, path = parts(F.col(url))
    rows = with_grams(urls.select(*kept), url, size)
    scored = model.transform(rows.withColumn("__row", F.struct(*kept)).select("__row", "__grams"))
    score = vector_to_array("__probability")[1]
    out = scored.select("__row.*", score.alias("score"))
    out = out.withColumns({"__host": host, "__path": path})
    out = out.withColumn("__rule", matching_rule(F.col("__host"), F.col("__path"), rules))
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.select(
        *[c for c in kept if c not in ("host", "path", "rule", "score", "verdict")],
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__rule.rule").alias("rule"),
        F.col("score"),
        F.coalesce("__rule.verdict", own).alias("verdict"),
    )
