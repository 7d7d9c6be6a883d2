"""Toxicity: gradient-boosted trees over a few dense features, calibrated by isotonic regression.

Features are rates over the whole text: a fixed lexicon and one learned from labels, how
near hits are to the second person, capitals, punctuation, and spellings that hide a word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from separatrix.llm.scratch import Scratch

# Plain English insults, and second-person words of four languages.
INSULTS = (
    "clown", "coward", "creep", "disgusting", "dumb", "filth", "fool", "garbage", "idiot", "idiots", "imbecile", "jerk",
    "liar", "loser", "losers", "lunatic", "maggot", "moron", "morons", "parasite", "pathetic", "pig", "rat", "scum",
    "stupid", "trash", "ugly", "vermin", "worthless", "wretch",
)
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "ihr", "euch", "tu", "toi", "te", "ton",
    "vous", "votre", "usted", "ustedes", "ti", "tus",
)
# Signs that stand for letters in hidden spellings.
STANDS_FOR = str.maketrans("013457@$!*", "oieastasii")

WORD = re.compile(r"[^\W_]++(?:[@$!*'][^\W_]++)*+")
# A word with signs or digits between its letters; possessive, so that long runs are passed once.
HIDDEN = re.compile(r"(?<![\w@$!*])[\d@$!*]*+[^\W\d_]++(?:[\d@$!*]++[^\W\d_]++)++")
CAPITAL_WORD = re.compile(r"(?<!\S)[A-Z][A-Z!?.,]++(?!\S)")
REPEATED = re.compile(r"([!?.])\1+")

FEATURES = (
    "lexicon", "lexicon_log", "learned", "learned_log", "learned_most", "learned_weight", "second_person", "near_second_person",
    "capitals", "capital_words", "exclamations", "questions", "repeated_marks", "punctuation", "hidden", "hidden_hits", "log_words",
)
# A hit counts as near within so many words of the second person.
NEAR = 5


@dataclass(frozen=True)
class Settings:
    """``most_rows`` bounds the labelled rows that the classifier is fitted on, by a digest of the key."""

    most_rows: int = 20_000
    lexicon: int = 4000  # learned entries, those of most weight
    least_documents: int = 4  # that an entry must occur in
    prefixes: tuple[int, ...] = (4, 5, 6)  # beginnings of words that are entries, too
    trees: int = 20
    depth: int = 4
    step: float = 0.3
    seed: int = 7


def words_of(text: str) -> list[str]:
    return WORD.findall(text.casefold())


def entries(word: str, prefixes: tuple[int, ...]) -> list[str]:
    """A word and its marked beginnings."""
    return [word, *(word[:n] + "-" for n in prefixes if len(word) >= n)]


class Features:
    def __init__(self, lexicon: dict[str, float], settings: Settings):
        self.fixed, self.lexicon, self.prefixes = frozenset(INSULTS), lexicon, settings.prefixes
        self.second = frozenset(SECOND_PERSON)
        self.weights: dict[str, float] = {}
        # 1 for marks, 2 for capitals, by code point; letters, digits and white space are 0.
        points = map(chr, range(0x110000))
        self.kinds = np.fromiter((2 if c.isupper() else not (c.isalnum() or c.isspace()) for c in points), np.uint8, 0x110000)

    def weight(self, word: str) -> float:
        """The largest weight of a word's entries; tasks remember words they have met."""
        known = self.weights.get(word)
        if known is None:
            if len(self.weights) > 500_000:
                self.weights.clear()
            known = self.weights[word] = max((self.lexicon.get(e, 0.0) for e in entries(word, self.prefixes)), default=0.0)
        return known

    def of(self, text: str) -> list[float]:
        words, size = words_of(text), max(1, len(text))
        n = max(1, len(words))
        # Distinct words first: most texts have no hit, and need no look at positions.
        distinct = set(words)
        plain = distinct & self.fixed
        learned = {w: x for w in distinct if (x := self.weight(w)) > 0}
        persons = distinct & self.second
        times = {w: words.count(w) for w in plain | persons} if plain or persons else {}
        times |= {w: words.count(w) for w in learned if w not in times}
        n_plain, n_learned = sum(times[w] for w in plain), sum(times[w] for w in learned)
        near = 0
        if persons and (plain or learned):
            at = np.flatnonzero(np.fromiter((w in persons for w in words), bool, len(words)))
            hits = np.flatnonzero(np.fromiter((w in learned or w in plain for w in words), bool, len(words)))
            after = np.searchsorted(at, hits)
            to_next = at[np.minimum(after, len(at) - 1)] - hits
            to_last = hits - at[np.maximum(after - 1, 0)]
            near = int((np.minimum(np.abs(to_next), np.abs(to_last)) <= NEAR).sum())
        hidden = HIDDEN.findall(text)
        unhidden = [h.casefold().translate(STANDS_FOR) for h in hidden]
        kinds = np.bincount(self.kinds[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=3)
        return [
            n_plain / n, math.log1p(n_plain), n_learned / n, math.log1p(n_learned), max(learned.values(), default=0.0),
            sum(times[w] * x for w, x in learned.items()) / n, sum(times[w] for w in persons) / n, near / n,
            kinds[2] / size, len(CAPITAL_WORD.findall(text)) / n, text.count("!") / size, text.count("?") / size,
            len(REPEATED.findall(text)) / n, kinds[1] / size, len(hidden) / n,
            sum(u in self.fixed or self.weight(u) > 0 for u in unhidden) / n, math.log1p(len(words)),
        ]


def with_features(docs: DataFrame, key: str, text: str, lexicon: dict[str, float], settings: Settings, *more: str) -> DataFrame:
    """Key, ``more`` and ``features`` (array of double); a null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = [key, *more]
    kinds = dict(docs.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shared.value, settings)
        for batch in batches:
            found = [features.of(t.as_py() or "") for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, pa.list_(pa.float64()))], [*names, "features"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "features array<double>"])
    return docs.select(*names, F.col(text).alias("__text")).mapInArrow(work, schema)


def learn_lexicon(rows: DataFrame, text: str, label: str, settings: Settings) -> dict[str, float]:
    """Entries that occur much more often in toxic than in other documents, with their log odds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_of, toxic = Counter(), Counter()

        def emit():
            keys = list(all_of)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([all_of[k] for k in keys], pa.int64()), pa.array([toxic[k] for k in keys], pa.int64())],
                ["entry", "n", "toxic"],
            )

        for batch in batches:
            for content, mark in zip(batch.column(0), batch.column(1), strict=True):
                found = {e for w in set(words_of(content.as_py() or "")) for e in entries(w, settings.prefixes)}
                all_of.update(found)
                if mark.as_py() == 1:
                    toxic.update(found)
                if len(all_of) > 500_000:
                    yield emit()
                    all_of.clear(), toxic.clear()
        yield emit()

    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("t")).first()
    if not total["n"] or not total["t"] or total["t"] == total["n"]:
        return {}
    counts = rows.select(text, F.col(label).cast("int").alias(label)).mapInArrow(count, "entry string, n long, toxic long")
    counts = counts.groupBy("entry").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t")).filter(F.col("n") >= settings.least_documents)
    rest, t, n = total["n"] - total["t"], F.col("t"), F.col("n")
    odds = F.log((t + 0.1) / (total["t"] + 0.2)) - F.log((n - t + 0.1) / (rest + 0.2))
    # One standard error of the log odds is taken off, so rare entries need more.
    sure = odds - F.sqrt(1 / (t + 0.1) + 1 / (n - t + 0.1)) * 0.5
    top = counts.select("entry", sure.alias("weight")).filter("weight > 2").orderBy(F.desc("weight"), "entry").limit(settings.lexicon)
    return {r["entry"]: r["weight"] for r in top.collect()}


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    trees: object  # None if the labels do not tell two classes apart
    isotonic: object
    prior: float
    settings: Settings


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", settings: Settings = Settings()
) -> Model:
    """Fit on rows of ``docs`` that ``labels`` (key and 0 or 1) marks, at most about ``most_rows`` of them.

    The labels with the least digests of the key are taken before texts are looked up, so
    what is gathered stays bounded. Separate parts of the rows teach the lexicon, the trees
    and the calibration. Other labels than 0 and 1 are left out.
    """
    scratch = Scratch(docs.sparkSession)
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label"))
    total = known.agg(F.count(F.lit(1)).alias("n"), F.sum("__label").alias("t")).first()
    n, t = total["n"], total["t"] or 0
    prior = (t + 1) / (n + 2)
    digest = F.pmod(F.xxhash64(F.col("__key").cast("string"), F.lit(settings.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = min(1.0, settings.most_rows / max(1, n))
    taken = known.withColumn("__u", digest / F.lit(share)).filter("__u < 1")
    texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    taken = scratch.keep(texts.join(taken, "__key"), "labelled")
    lexicon = learn_lexicon(taken.filter("__u < 0.45"), "__text", "__label", settings)
    rows = with_features(taken.filter("__u >= 0.45"), "__key", "__text", lexicon, settings, "__label", "__u")
    rows = rows.select(F.col("__label").cast("double").alias("label"), array_to_vector("features").alias("features"), "__u").persist()
    try:
        fit, held = rows.filter("__u < 0.8"), rows.filter("__u >= 0.8")
        if fit.select("label").distinct().count() < 2 or held.isEmpty():
            return Model(lexicon, None, None, prior, settings)
        trees = GBTClassifier(
            labelCol="label", featuresCol="features", maxIter=settings.trees, maxDepth=settings.depth, stepSize=settings.step, seed=settings.seed
        ).fit(fit)
        raw = trees.transform(held).select("label", vector_to_array("probability")[1].alias("raw"))
        isotonic = IsotonicRegression(labelCol="label", featuresCol="raw", predictionCol="score").fit(raw)
    finally:
        rows.unpersist()
        scratch.drop("labelled")
    return Model(lexicon, trees, isotonic, prior, settings)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.5) of each row.

    A null text is empty, and empty texts are scored like all others. A model of rows with
    one class gives every row the share of that class. Rows that repeat come back as often.
    """
    if model.trees is None:
        out = docs.select(F.col(key), F.lit(float(model.prior)).alias("score"))
    else:
        rows = with_features(docs, key, text, model.lexicon, model.settings).withColumn("features", array_to_vector("features"))
        raw = model.trees.transform(rows).select(F.col(key), vector_to_array("probability")[1].alias("raw"))
        # Isotonic steps are flat; a thousandth of the trees' probability keeps the order within a step.
        blend = F.col("score") * 0.999 + F.col("raw") * 0.001
        out = model.isotonic.transform(raw).select(F.col(key), F.least(F.lit(1.0), F.greatest(F.lit(0.0), blend)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
