"""Pages as a legacy archive, converted to WARC and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from separatrix.llm import archives
from separatrix.llm.registry import query, table
from separatrix.llm.scratch import Scratch
from separatrix.storage import fresh_path

# Pages carry no time of their own.
DATE = "20000101000000"

SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""


@query("6", SQL)
def op6_arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    # A page without an id has no such header and comes back without one.
    place = F.coalesce(F.concat(F.lit("X-Place: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    block = archives.http_block(F.coalesce("html", F.lit("")), place)
    rows = pages.select("url", F.lit("0.0.0.0").alias("ip"), F.lit(DATE).alias("date"), F.lit("text/html").alias("mime"), block.alias("block"))
    scratch, new = Scratch(spark), fresh_path(spark, "warc")
    old = scratch.own(fresh_path(spark, "arc"), "arc")
    archives.write_arc(rows, old)
    # Stored, as finding copies and writing both read the converted records.
    converted = scratch.keep(archives.convert(archives.sound(archives.read_arc(spark, old))), "converted")
    scratch.drop("arc")
    archives.write_warc(archives.mark_revisits(converted), new)
    scratch.drop("converted")

    back = archives.sound(archives.read_warc(spark, new))
    headers, http = F.col("headers"), F.concat(F.substring_index(F.col("block").cast("string"), "\r\n\r\n", 1), F.lit("\r\n"))
    # Without a match there is no number.
    number = lambda name: F.nullif(F.regexp_extract(http, rf"(?i)\r\n{name}: (-?\d+)\r\n", 1), F.lit("")).cast("long")
    return back.select(
        number("X-Place").alias("page_id"),
        number("Content-Length").alias("payload_bytes"),
        F.substring_index(headers["WARC-Payload-Digest"], ":", -1).alias("payload_digest"),
        headers["WARC-Type"].alias("record_type"),
        headers["WARC-Refers-To-Place"].cast("long").alias("refers_to"),
    )
