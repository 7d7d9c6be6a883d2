"""Exact deduplication by recipes of content-defined chunks.

Each text is cut where its own content says so. Distinct chunks meet once, after
map-side combining, to make sure that a chunk's identifier stands for one content.
Documents then travel as short ordered lists of identifiers; texts do not move again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from separatrix.llm.scratch import Scratch

# Shortest and longest chunk in characters.
SHORTEST, LONGEST = 256, 4096
# First and last letters of scripts whose letters stand in blocks of Unicode: a letter counts by its place.
LATIN = ("AZ", "\u00e0\u00ff")
ALPHABETS = ("\u03b1\u03c9", "\u0410\u044f", "\u05d0\u05ea", "\u0621\u064a", "\u0905\u0939", "\u0e01\u0e2e", "\u3041\u3096", "\u30a1\u30fa")
# Scripts of thousands of signs, in stretches of 64.
SIGNS = ("\u4e00\u9fff", "\uac00\ud7a3")


def _letters(blocks: tuple[str, ...], start: int, step: int) -> str:
    return "".join(rf"\x{{{c:x}}}" for first, last in blocks for c in range(ord(first) + start, ord(last) + 1, step))


def _latin(start: int, step: int, small: str) -> str:
    """A class of Latin letters and digits, all below 256, which is a table look-up."""
    return f"[{small}{''.join(map(str, range(start % 4, 10, 4)))}{_letters(LATIN, start, step)}]"


def _others(start: int, step: int, more: str = "") -> str:
    """A class of every ``step``-th letter of other alphabets, or stretch of signs; one comparison tells Latin text."""
    signs = "".join(rf"\x{{{c:x}}}-\x{{{c + 63:x}}}" for first, last in SIGNS for c in range(ord(first) + 64 * start, ord(last) - 63, 64 * step))
    return rf"[{more}[\x{{100}}-\x{{ffff}}&&[{_letters(ALPHABETS, start, step)}{signs}]]]"


# A chunk ends after three such characters in sequence, which are about one place in 200 of
# Latin text and one in 100 to 300 of other scripts.
ENDING = (
    "(?:" + _latin(0, 6, "ptx") + _latin(2, 5, r"ei\x20") + _latin(1, 6, "cgkosw") + "|" + _others(0, 6) + _others(2, 5, r"\x20") + _others(1, 6) + ")"
)


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The chunks of a text in order; together they are the text, and '' has none.

    The first end at least ``shortest`` characters after the last one counts, and
    ``longest`` characters without any end are cut there.
    """
    ahead = rf"(?s).{{{shortest},{longest}}}?(?<={ENDING})|.{{{longest}}}|.+"
    return F.regexp_extract_all(text, F.lit(ahead), F.lit(0))


def _ambiguous(parts: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one content."""
    distinct = parts.select("id", "chunk").distinct()
    return distinct.groupBy("id").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("id")


def recipes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    identifier: Callable[[Column], Column] = F.xxhash64,
    shortest: int = SHORTEST,
    longest: int = LONGEST,
) -> DataFrame:
    """Key, ``recipe`` (ordered chunk identifiers) and ``text_sha256`` of each row.

    Two rows have the same recipe exactly if they have the same text. An identifier that
    several contents share gets the content's rank among them as a second number.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(F.col(key).alias("key"), chunks(whole, shortest, longest).alias("chunks"), F.sha2(whole, 256).alias("text_sha256"))
    ids = F.transform("chunks", lambda c: identifier(c))
    plain = F.transform(ids, lambda i: F.struct(i.alias("id"), F.lit(0).alias("rank")))
    scratch = Scratch(docs.sparkSession)
    listed = scratch.keep(cut.select("key", plain.alias("recipe"), "text_sha256"), "recipes")

    parts = cut.select(F.explode("chunks").alias("chunk")).select(identifier(F.col("chunk")).alias("id"), "chunk")
    shared = scratch.keep(_ambiguous(parts), "ambiguous-chunks")
    if shared.isEmpty():
        scratch.drop("ambiguous-chunks")
        return listed
    # Rank the contents of shared identifiers, and write anew the recipes that hold one.
    contents = parts.join(shared, "id", "left_semi").select("id", "chunk").distinct()
    ranked = contents.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("chunk")))
    # Only texts that hold a shared identifier, each of them once: one text has one recipe, whatever its keys.
    rows = cut.select("text_sha256", F.posexplode("chunks").alias("at", "chunk")).withColumn("id", identifier(F.col("chunk")))
    held = rows.join(shared, "id", "left_semi").select("text_sha256").distinct()
    rows = rows.join(held, "text_sha256", "left_semi").join(ranked, ["id", "chunk"], "left")
    step = F.struct("at", "id", F.coalesce("rank", F.lit(0)).alias("rank"))
    anew = rows.groupBy("text_sha256").agg(F.array_sort(F.collect_set(step)).alias("steps"))
    anew = anew.select("text_sha256", F.transform("steps", lambda s: F.struct(s["id"], s["rank"])).alias("better"))
    joined = listed.join(anew, "text_sha256", "left")
    final = scratch.keep(joined.select("key", F.coalesce("better", "recipe").alias("recipe"), "text_sha256"), "final-recipes")
    scratch.drop("recipes", "ambiguous-chunks")
    return final


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **cutting) -> DataFrame:
    """One row for each row of ``docs``: key, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the largest key stays. A null text counts as empty. Rows without a key
    stay rows of their group and are never the one that stays, unless all lack a key; then
    ``keep_id`` is null and ``kept`` is true. Rows that repeat a key with the same text each
    count, and are kept or dropped alike. An empty table gives no rows; other columns are
    not read.
    """
    listed = recipes(docs, key, text, **cutting)
    groups = listed.groupBy("recipe").agg(F.max("key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Only groups with copies go back to the rows.
    copies = groups.filter("group_size > 1").withColumn("copied", F.lit(True))
    rows = listed.join(copies, "recipe", "left")
    keep = F.when(F.col("copied"), F.col("keep_id")).otherwise(F.col("key"))
    return rows.select(
        F.col("key").alias(key),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("key")).alias("kept"),
        "text_sha256",
    )
