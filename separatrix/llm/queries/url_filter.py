"""Verdicts on the addresses of pages. The regression has no SQL; tests use brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from separatrix.llm import url_filter
from separatrix.llm.registry import query, table


@query("3")
def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark))
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge(pages, model).select("page_id", "host", "path", "rule", "score", "verdict")
