"""Incremental secret scans over a ledger of content-addressed blobs.

Every version of a text is a blob, named by the digest of its content. The ledger holds a
row for each blob and rule version that was ever scanned, findings or none. A scan reads
only the pairs that the ledger lacks, and findings go back to all rows that hold the blob.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from separatrix.storage import fresh_path


@dataclass(frozen=True)
class Rule:
    """``pattern`` must have no capture groups but the one that ``value`` names.

    Matches are leftmost and do not overlap; those whose value (the whole match without a
    group) has fewer than ``least`` characters are dropped. ``hint`` is a cheap condition on
    the text that holds wherever the pattern can match.
    """

    kind: str
    version: int
    pattern: str
    hint: str
    has_value: bool = False
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The first three are the stated rules, in the order in which they are listed.
RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         r"lower({0}) like '%passw%' or lower({0}) like '%secret%' or lower({0}) like '%token%' or lower({0}) like '%api%key%'",
         has_value=True, least=6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", "contains({0}, 'AKIA')", least=20),
    Rule("hex", 1, r"[0-9a-f]+", "{0} rlike '[0-9a-f]{{24}}'", least=24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "contains({0}, 'PRIVATE KEY-----')"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", "contains({0}, 'gh') and {0} rlike 'gh[pousr]_'"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", "contains({0}, 'eyJ')"),
)

SPANS = "array<struct<start:int,end:int>>"
# Items of a list that are worked on together.
STRETCH = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _stretches(items: Column) -> Column:
    last = F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / STRETCH).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * STRETCH + 1, F.lit(STRETCH)))


def _scan(
    items: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str
) -> Column:
    """``emit(state, item)`` (of type ``kind``) for each item, with the state that ``step`` made of the items before it.

    An array that grows is copied at each item, so a long list is scanned in stretches, and
    only the results of whole stretches are put together.
    """

    def stretch(part: Column, state: Column) -> Column:
        def add(done: Column, item: Column) -> Column:
            return F.struct(step(done["state"], item).alias("state"), F.concat(done["out"], F.array(emit(done["state"], item))).alias("out"))

        return F.aggregate(part, F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), add)

    def add_stretch(done: Column, part: Column) -> Column:
        return _let(stretch(part, done["state"]), lambda r: F.struct(r["state"].alias("state"), F.concat(done["outs"], F.array(r["out"])).alias("outs")))

    nothing = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("outs"))
    return _let(items, lambda known: F.aggregate(_stretches(known), nothing, add_stretch, lambda done: F.flatten(done["outs"])))


def spans(text: str, rule: Rule) -> Column:
    """Starts and ends (exclusive) of a rule's matches in a text column, in code points.

    Each step of the search takes the gap since the last match along with the match, so
    lengths add up to positions. \\G keeps a failed step from trying later starts.
    """
    steps = F.lit(rf"(?s)\G(.*?)(?:{rule.pattern})")
    whole, gap = (F.regexp_extract_all(F.col(text), steps, F.lit(g)) for g in (0, 1))
    value = F.regexp_extract_all(F.col(text), steps, F.lit(2)) if rule.has_value else whole
    parts = F.arrays_zip(
        F.transform(whole, F.length).alias("whole"), F.transform(gap, F.length).alias("gap"), F.transform(value, F.length).alias("value")
    )

    def match(at: Column, part: Column) -> Column:
        value = part["value"] if rule.has_value else part["whole"] - part["gap"]
        return F.struct((at + part["gap"]).alias("start"), (at + part["whole"]).alias("end"), (value >= rule.least).alias("counts"))

    found = _scan(parts, F.lit(0), lambda at, part: at + part["whole"], match, "struct<start:int,end:int,counts:boolean>")
    found = F.transform(F.filter(found, lambda m: m["counts"]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    return F.when(F.expr(rule.hint.format(text)), found).otherwise(F.array().cast(SPANS))


def blobs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each distinct content once: ``blob_id``, ``blob``. A null text is empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.sha2(whole, 256).alias("blob_id"), whole.alias("blob")).distinct()


def unseen(contents: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Blobs that the ledger lacks for one rule version or more, with ``missing`` rule names."""
    names = F.array(*(F.lit(r.name) for r in rules))
    if ledger is None:
        return contents.withColumn("missing", names)
    seen = ledger.filter(F.col("rule").isin([r.name for r in rules])).groupBy("blob_id").agg(F.collect_set("rule").alias("seen"))
    todo = contents.join(seen, "blob_id", "left")
    todo = todo.withColumn("missing", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))))
    return todo.filter(F.size("missing") > 0).drop("seen")


def scan(contents: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: ``blob_id``, ``rule``, ``spans``, one for each unseen pair."""
    todo = unseen(contents, ledger, rules)
    each = [
        F.when(F.array_contains("missing", r.name), F.struct(F.lit(r.name).alias("rule"), spans("blob", r).alias("spans"))) for r in rules
    ]
    found = todo.select("blob_id", F.explode(F.array_compact(F.array(*each))).alias("found"))
    return found.select("blob_id", "found.rule", "found.spans")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"blob_id string, rule string, spans {SPANS}").parquet(path)


def update(docs: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES, first: bool = False) -> DataFrame:
    """Scan what the ledger at ``path`` lacks, append it, and return the ledger."""
    spark = docs.sparkSession
    ledger = None if first else read_ledger(spark, path)
    scan(blobs(docs, text), ledger, rules).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob_id`` and ``found`` (start, place of the rule, kind, end) of blobs with findings.

    A blob has one ledger row for each rule, so its list is gathered from a few rows; a rule
    that was scanned twice by jobs side by side counts once.
    """
    order = F.create_map(*(F.lit(x) for r in rules for x in (r.name, rules.index(r))))
    kind = F.create_map(*(F.lit(x) for r in rules for x in (r.name, r.kind)))
    rows = ledger.filter(F.col("rule").isin([r.name for r in rules]) & (F.size("spans") > 0))
    # Rows are told apart as a whole: comparing long lists element by element would be quadratic.
    gathered = rows.groupBy("blob_id").agg(F.collect_set(F.struct("rule", "spans")).alias("by_rule"))

    def tagged(r: Column) -> Column:
        place, name = order[r["rule"]], kind[r["rule"]]
        return F.transform(r["spans"], lambda s: F.struct(s["start"].alias("start"), place.alias("place"), name.alias("kind"), s["end"].alias("end")))

    return gathered.select("blob_id", F.array_sort(F.flatten(F.transform("by_rule", tagged))).alias("found"))


def findings(docs: DataFrame, ledger: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``found`` (kind, start, end; by start, then the order of rules) for each row of ``docs``.

    A null text is empty and has none. Rows that repeat, and keys that are null, each get
    their findings; an empty table gives no rows.
    """
    paths = docs.select(F.col(key), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob_id"))
    nothing = F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")
    return paths.join(by_blob(ledger, rules), "blob_id", "left").withColumn("found", F.coalesce("found", nothing))


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, deliveries: int = 1) -> DataFrame:
    """Findings of every row over a new ledger.

    Rows come in so many ``deliveries``, by digest of their keys. Each one scans only the
    blobs that those before it did not bring.
    """
    path = fresh_path(docs.sparkSession, "ledger")
    ledger = None
    for n in range(deliveries):
        part = docs.filter(F.pmod(F.xxhash64(key), F.lit(deliveries)) == n) if deliveries > 1 else docs
        ledger = update(part, path, text, rules, first=ledger is None)
    return findings(docs, ledger, key, text, rules)


def _redacted(text: Column, found: Column) -> Column:
    """The text with every found span replaced by its kind in brackets; overlaps merge.

    Texts are cut from the start each time, so a stretch of spans first cuts out its own part.
    """

    def piece(at: Column, s: Column) -> Column:
        mark = F.when(s["start"] >= at, F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(at.alias("at"), F.greatest(s["start"] - at, F.lit(0)).alias("n"), mark.alias("mark"))

    pieces = _scan(found, F.lit(0), lambda at, s: F.greatest(at, s["end"]), piece, "struct<at:int,n:int,mark:string>")

    def join(part: Column) -> Column:
        first, last = F.get(part, F.lit(0)), F.get(part, F.size(part) - 1)
        own = F.substring(text, first["at"] + 1, last["at"] + last["n"] - first["at"])
        return _let(own, lambda t: F.array_join(F.transform(part, lambda p: F.concat(F.substring(t, p["at"] - first["at"] + 1, p["n"]), p["mark"])), ""))

    end = F.array_max(F.transform(found, lambda s: s["end"]))
    return F.concat(_let(pieces, lambda known: F.array_join(F.transform(_stretches(known), join), "")), F.substring(text, end + 1, F.length(text)))


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with secrets replaced by the kind in brackets; all rows and columns stay.

    Spans go back by blob, so only texts with findings are rewritten. A null text stays null.
    """
    ledger = update(docs, fresh_path(docs.sparkSession, "ledger"), text, rules, first=True)
    found = by_blob(ledger, rules).select(F.col("blob_id").alias("__blob"), F.col("found").alias("__found"))
    rows = docs.withColumn("__blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).join(found, "__blob", "left")
    clean = F.when(F.col("__found").isNull(), F.col(text)).otherwise(_redacted(F.col(text), F.col("__found")))
    return rows.withColumn(text, clean).select(*docs.columns)


def joined(found: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def any_of(found: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(found, lambda s: reduce(lambda a, b: a | b, (s["kind"] == k for k in kinds)))
