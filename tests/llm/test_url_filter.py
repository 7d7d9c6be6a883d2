import re

import pytest
from pyspark.sql import functions as F

from separatrix.llm import url_filter

URLS = [
    "https://www.ORG/a", "http://x.Example.org/es/1?q=/en/1", "https://example.org/en/1", "https://example.org/en/2", "https://example.org", "//no",
    None, "", "http://", "https://a.com/fr/x#y", "ftp://b.com/de/", "http://b.com/de", "http://notorg/x", "a://b://c/d", "http://É.COM/fr/", "x\ny://h\n/p\n?q",
    "https://cheap-pills.example.net/en/1", "https://ththre.example.net/en/25", "http://" + "h" * 30_000 + ".net/" + "p" * 30_000,
]


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, verdict in url_filter.RULES:
        domain, start = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return host, path, max(fits, default=(0, None, None))


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.train(url_filter.labelled_urls(spark))


def test_rules_and_parts(spark, model):
    rows = [(i, u, "clash", 0.5, "v") for i, u in [*enumerate(URLS), (0, URLS[0])]]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, score double, verdict string")
    got = url_filter.judge(pages, model).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, (_, rule, verdict) = expected(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r["url"]
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow")) and 0 <= r["score"] <= 1
    verdicts = {r["url"]: r["verdict"] for r in got}
    assert verdicts[URLS[16]] == "block" and verdicts[URLS[17]] == "allow"
    assert url_filter.judge(pages.limit(0), model).count() == 0


def test_regression_on_words_of_its_kind(spark, model):
    urls = [(f"http://m.{w}.example.com/en/9", 1) for w in ("casino-royal", "free-bets", "pharma-deals")]
    urls += [(f"http://m.{w}.example.com/en/9", 0) for w in ("librarybooks", "qwzxv", "museums")]
    got = url_filter.judge(spark.createDataFrame(urls, "url string, unwanted int"), model, rules=()).collect()
    assert all((r["score"] > 0.5) == (r["unwanted"] == 1) for r in got), got


def test_scores_follow_the_formula(spark, model):
    """Probability by hand from the sum of the weights of an address's distinct n-grams."""
    import math

    urls = spark.createDataFrame([(u,) for u in URLS if u and len(u) < 1000], "url string")
    grams = {r["url"]: r["__grams"] for r in url_filter.with_grams(urls, "url", 4).collect()}
    hashing, learner = model.stages
    weights, intercept = learner.coefficients.toArray(), learner.intercept
    for r in url_filter.judge(urls.withColumn("page", F.col("url")), model).collect():
        margin = intercept + sum(weights[g] for g in {hashing.indexOf(g) for g in grams[r["page"]]})
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9), r["page"]


def test_words_that_were_held_out(spark):
    """Words of both kinds that the model has not seen, in all their forms."""
    labelled = url_filter.labelled_urls(spark)
    held = [w for words in (url_filter.UNWANTED, url_filter.WANTED) for w in words[::6]]
    unseen = F.rlike("url", F.lit("|".join(rf"\b{w}\.example" for w in held)))
    model = url_filter.train(labelled.filter(~unseen))
    judged = url_filter.judge(labelled.filter(unseen), model, rules=())
    right = judged.agg(F.avg(((F.col("score") >= 0.5) == (F.col("unwanted") == 1)).cast("double"))).first()[0]
    assert judged.count() == 16 * len(held) and right >= 0.5
