"""Language identification by mixture inference.

A document is a bag of hashed character n-grams drawn from a mixture of languages. The
proportions come from expectation maximisation, and a language joins the mixture only if
the likelihood it adds pays for a penalty, as in the Bayesian information criterion.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

UNDETERMINED = "und"
# Most cells a model may have; it travels to every task.
MODEL_CELLS = 1 << 24


@dataclass(frozen=True)
class Settings:
    size: int = 3  # letters in an n-gram
    bits: int = 15  # n-grams are hashed to 2 ** bits buckets
    smoothing: float = 0.5  # added to every count
    penalty: float = 4.0  # a further language costs penalty * ln(n-grams) / 2
    rounds: int = 40  # of expectation maximisation, at most
    settled: float = 1e-4  # largest change of a proportion at the end


class Grams:
    """Hashed n-grams of the letters in a text; other characters are one space each run."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        # Odd multipliers, one for each place in the n-gram.
        self.factors = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 | 1 for i in range(settings.size)], np.uint64)

    def letters(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(self.letter[codes], codes, 32)
        codes = np.concatenate(([32], codes, [32])).astype(np.uint32)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        return codes[keep]

    def buckets(self, text: str) -> np.ndarray:
        """Bucket of each n-gram; none if the text has no letter."""
        codes = self.letters(text)
        n = self.settings.size
        if len(codes) < 3:  # only spaces
            return np.empty(0, np.int64)
        if len(codes) < n:
            codes = np.concatenate((codes, np.full(n - len(codes), 32, np.uint32)))
        wide = codes.astype(np.uint64)
        mixed = np.zeros(len(wide) - n + 1, np.uint64)
        for i, factor in enumerate(self.factors):
            mixed += wide[i : len(wide) - n + 1 + i] * factor
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(64 - self.settings.bits)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    likelihood: np.ndarray  # languages x buckets
    settings: Settings


def train(docs: DataFrame, text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> Model:
    """Count n-grams of every row with text and language, by language.

    Each task adds up its own rows first, so a language or source that holds most rows is
    no hot key, and the driver gets one row for each language and bucket that occurs.
    """
    size = 1 << settings.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Grams(settings), {}
        for batch in batches:
            for content, language in zip(batch.column(0), batch.column(1), strict=True):
                found = grams.buckets(content.as_py())
                if language.as_py() not in sums:
                    sums[language.as_py()] = np.zeros(size, np.int64)
                sums[language.as_py()] += np.bincount(found, minlength=size)
        for language, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at)), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])

    rows = docs.select(text, lang).filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sums = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums.persist()
    try:
        known = sorted(r["lang"] for r in sums.select("lang").distinct().limit(MODEL_CELLS // size + 1).collect())
        if len(known) * size > MODEL_CELLS:
            raise ValueError(f"{len(known)} languages and more x {size} buckets exceed {MODEL_CELLS} cells; use fewer bits")
        # Numbers only: the place of a language in their order, its buckets and counts.
        place = F.array_position(F.lit(known), F.col("lang")) - 1 if known else F.lit(0)
        found = sums.select(place.cast("int").alias("place"), "bucket", "n").toArrow()
    finally:
        sums.unpersist()
    counts = np.full((len(known), size), settings.smoothing)
    at, bucket, n = (found.column(c).to_numpy() for c in ("place", "bucket", "n"))
    counts[at, bucket] += n
    return Model(tuple(known), counts / counts.sum(axis=1, keepdims=True), settings)


def _proportions(rows: np.ndarray, counts: np.ndarray, start: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Expectation maximisation: proportions and log likelihood."""
    shares, total = start, counts.sum()
    for _ in range(settings.rounds):
        new = shares * (rows.T @ (counts / (rows @ shares))) / total
        moved = np.abs(new - shares).max()
        shares = new
        if moved < settings.settled:
            break
    return shares, float(counts @ np.log(rows @ shares))


def infer(model: Model, buckets: np.ndarray) -> tuple[dict[int, float], float]:
    """Proportions of the chosen languages and the mean log likelihood of an n-gram."""
    settings = model.settings
    counts = np.bincount(buckets, minlength=1 << settings.bits)
    at = np.flatnonzero(counts)
    counts = counts[at].astype(float)
    total = counts.sum()
    rows = model.likelihood[:, at].T.copy()
    alone = counts @ np.log(rows)
    chosen = [int(np.argmax(alone))]
    shares, best = np.ones(1), float(alone[chosen[0]])
    cost = settings.penalty * math.log(max(total, 2.0)) / 2
    while len(chosen) < len(model.languages):
        # The likelihood is concave: a language whose slope is not above 1 cannot add any.
        slopes = (counts / (rows[:, chosen] @ shares)) @ rows / total
        slopes[chosen] = 0.0
        gains = []
        for m in np.flatnonzero(slopes > 1.0):
            # An upper bound on what a step towards m can add.
            if total * math.log(slopes[m]) <= cost:
                continue
            start = np.append(shares * 0.8, 0.2)
            new, value = _proportions(rows[:, [*chosen, m]], counts, start, settings)
            gains.append((value - best, -int(m), new, value))
        if not gains or max(gains)[0] <= cost:
            break
        _, m, shares, best = max(gains, key=lambda g: g[:2])
        chosen.append(-m)
    return {c: float(s) for c, s in zip(chosen, shares, strict=True)}, best / total


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``languages`` (language and share).

    ``score`` is the share of the predicted language; of equal shares the first language by
    name wins. A text that is null or has no letter is ``und`` with score 0, and so is any
    text if the model has no language. Whole texts count; rows may repeat. Columns of
    ``docs`` with the names of new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in docs.columns if c not in ("lang_pred", "score", "languages")]
    kinds = dict(docs.dtypes)
    names = [*carried, "lang_pred", "score", "languages"]
    place = carried.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        grams = Grams(model.settings)
        for batch in batches:
            found, scores, lists = [], [], []
            for content in batch.column(place):
                buckets = grams.buckets(content.as_py() or "")
                if not len(buckets) or not model.languages:
                    found.append(UNDETERMINED), scores.append(0.0), lists.append([])
                    continue
                shares, _ = infer(model, buckets)
                top = min(shares, key=lambda c: (-shares[c], c))
                found.append(model.languages[top])
                scores.append(min(1.0, max(0.0, shares[top])))
                lists.append([{"lang": model.languages[c], "share": s} for c, s in sorted(shares.items())])
            mixture = pa.array(lists, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            columns = [*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64()), mixture]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried)
    return docs.select(*carried).mapInArrow(
        work, f"{schema}, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    )
