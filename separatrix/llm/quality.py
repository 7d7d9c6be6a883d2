"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features interacts by the product of two short vectors, so that for example
symbols behind words can count otherwise in short lines than in long ones. The sum over
all pairs follows in linear time from the square of sums less the sum of squares.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, functions as F

from separatrix.llm.scratch import Scratch

# Shares of words, characters or lines; each falls into a class between these borders.
SHARES = (
    "capital_words", "symbol_ends", "no_letters", "with_digits", "short_words", "long_words", "same_as_last", "repeated_words", "commonest",
    "repeated_lines", "short_lines", "capitals", "marks", "spaces", "letters",
)
BORDERS = np.array([0.0005, 0.002, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95])
# Sizes and numeric metadata fall into classes by their logarithm to base 2.
SIZES = ("words", "lines", "word_length")
CLASSES = 32
WORD = re.compile(r"[^\W_]+")
# Marks that often end a word of plain prose.
PLAIN_ENDS = frozenset(".,;:!?\"')]")


@dataclass(frozen=True)
class Settings:
    """``most_rows`` bounds the labelled rows that the model is fitted on, by a digest of the key."""

    most_rows: int = 20_000
    word_bits: int = 13  # words are hashed to 2 ** word_bits features
    shape_bits: int = 8
    factors: int = 4
    rounds: int = 60
    step: float = 0.1
    penalty: float = 1e-3
    seed: int = 11


def _classes_of_characters() -> np.ndarray:
    """A, a, 0 and white space stand for their kind; other ASCII characters for themselves, the rest is one mark."""
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else " " if c.isspace() else c if c < "\x80" else "?" for c in map(chr, range(0x110000)))
    return np.fromiter(map(ord, kinds), np.uint8, 0x110000)


def _size_class(x: float | None, finer: int = 1) -> int:
    return CLASSES - 1 if x is None or not math.isfinite(x) else min(CLASSES - 2, int(finer * math.log2(1 + abs(x))))


class Features:
    """Numbers and values of a text's features: words, shapes of words, structure, metadata.

    A shape is a word with each run of one kind of character as one sign, such as ``Aa,``.
    """

    def __init__(self, metadata: int, settings: Settings):
        from xxhash import xxh3_64_intdigest

        self.digest, self.settings, self.metadata = xxh3_64_intdigest, settings, metadata
        self.kinds = _classes_of_characters()
        self.shapes_at = 1 << settings.word_bits
        self.structure_at = self.shapes_at + (1 << settings.shape_bits)
        self.size = self.structure_at + CLASSES * (len(SHARES) + len(SIZES) + metadata)

    def _hashed(self, counts: Counter, bits: int, at: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct features of hashed keys, and their weights scaled to length 1."""
        seed, mask = self.settings.seed, (1 << bits) - 1
        places = np.fromiter((self.digest(key, seed) & mask for key in counts), np.int64, len(counts))
        where, group = np.unique(places, return_inverse=True)
        value = np.bincount(group, weights=weights)
        return at + where, value / math.sqrt(float(value @ value))

    def of(self, text: str, numbers: list[float | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of features without repeats, and their values."""
        kinds = self.kinds[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        amounts = np.bincount(kinds, minlength=256)
        size = max(1, len(kinds))
        lengths = np.diff(np.flatnonzero(np.concatenate(([True], kinds == 32, [True])))) - 1
        lengths = lengths[lengths > 0]
        n = max(1, len(lengths))
        fresh = np.ones(len(kinds), bool)
        fresh[1:] = kinds[1:] != kinds[:-1]
        shapes = Counter(kinds[fresh].tobytes().decode("latin-1").split(" "))
        shapes.pop("", None)
        words = WORD.findall(text.lower())
        counts, m = Counter(words), max(1, len(words))
        often, shaped = np.fromiter(counts.values(), np.float64, len(counts)), np.fromiter(shapes.values(), np.float64, len(shapes))
        parts = []
        if counts:
            parts.append(self._hashed(counts, self.settings.word_bits, 0, np.log1p(often)))
        if shapes:
            parts.append(self._hashed(shapes, self.settings.shape_bits, self.shapes_at, shaped))
        of_shapes = (
            lambda s: "A" in s and "a" not in s,
            lambda s: ("a" in s or "A" in s) and s[-1] not in "aA0" and s[-1] not in PLAIN_ENDS,
            lambda s: "a" not in s and "A" not in s,
            lambda s: "0" in s,
        )
        lines = [line for line in text.split("\n") if line.strip()]
        k = max(1, len(lines))
        letters = int(amounts[65] + amounts[97])
        shares = [
            *(sum(c for s, c in shapes.items() if has(s)) / n for has in of_shapes), int((lengths < 3).sum()) / n, int((lengths > 15).sum()) / n,
            sum(map(eq, words, words[1:])) / m, 1 - len(counts) / m, float(often.max(initial=0.0)) / m, 1 - len(set(lines)) / k,
            sum(len(line) < 30 for line in lines) / k, int(amounts[65]) / max(1, letters),
            int(len(kinds) - letters - amounts[48] - amounts[32]) / size, int(amounts[32]) / size, letters / size,
        ]
        classes = [int(c) for c in np.searchsorted(BORDERS, shares)]
        classes += [_size_class(len(words)), _size_class(len(lines)), _size_class(4 * int(lengths.sum()) / n, 3)]
        classes += [_size_class(x) for x in numbers]
        parts.append((self.structure_at + CLASSES * np.arange(len(classes)) + np.array(classes), np.full(len(classes), 1 / math.sqrt(len(classes)))))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def pairwise(values: np.ndarray, vectors: np.ndarray) -> float:
    """The sum over all pairs of features of the product of their values and vectors, in linear time."""
    weighted = vectors * values[:, None]
    return 0.5 * float((weighted.sum(axis=0) ** 2 - (weighted**2).sum(axis=0)).sum())


@dataclass(frozen=True)
class Model:
    intercept: float
    linear: np.ndarray | None  # None if the labels do not tell two classes apart
    vectors: np.ndarray | None
    prior: float
    metadata: tuple[str, ...]
    settings: Settings

    def raw(self, where: np.ndarray, values: np.ndarray) -> float:
        return self.intercept + float(self.linear[where] @ values) + pairwise(values, self.vectors[where])


def _narrow(docs: DataFrame, text: str, metadata: tuple[str, ...], *more: str) -> DataFrame:
    return docs.select(*more, F.col(text).alias("__text"), *(F.col(c).cast("double").alias(f"__meta_{i}") for i, c in enumerate(metadata)))


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", metadata: tuple[str, ...] = (),
    settings: Settings = Settings(),
) -> Model:
    """Fit on rows of ``docs`` that ``labels`` (key and 0 or 1) marks, at most about ``most_rows`` of them.

    The labels with the least digests of the key are taken before texts are looked up, so
    what is gathered stays bounded. Other labels than 0 and 1 are left out. ``metadata``
    names numeric columns of ``docs``; a null is a class of its own.
    """
    scratch = Scratch(docs.sparkSession)
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("__key"), F.col(label).cast("double").alias("label"))
    total = known.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("t")).first()
    n, t = total["n"], total["t"] or 0
    prior = (t + 1) / (n + 2)
    digest = F.pmod(F.xxhash64(F.col("__key").cast("string"), F.lit(settings.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = known.filter(digest < min(1.0, settings.most_rows / max(1, n)))
    rows = _narrow(docs, text, metadata, F.col(key).alias("__key")).join(taken, "__key").drop("__key")
    size, places = Features(len(metadata), settings).size, len(metadata)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(places, settings)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                numbers = zip(*(batch.column(1 + i).to_pylist() for i in range(places)), strict=True) if places else [()] * batch.num_rows
                found = [features.of(t.as_py() or "", list(x)) for t, x in zip(batch.column(0), numbers, strict=True)]
                lists = [pa.array([f[i] for f in found], kind) for i, kind in ((0, pa.list_(pa.int64())), (1, pa.list_(pa.float64())))]
                yield pa.RecordBatch.from_arrays([batch.column(1 + places), *lists], ["label", "at", "values"])

    # Only the bounded sample goes through row by row; scoring does not.
    vector = F.udf(lambda at, values: Vectors.sparse(size, sorted(zip(at, values, strict=True))), VectorUDT())
    stored = scratch.keep(rows.mapInArrow(work, "label double, at array<long>, values array<double>"), "labelled")
    sample = stored.select("label", vector("at", "values").alias("features")).persist()
    try:
        if sample.select("label").distinct().count() < 2:
            return Model(0.0, None, None, prior, metadata, settings)
        fitted = FMClassifier(
            labelCol="label", featuresCol="features", factorSize=settings.factors, maxIter=settings.rounds, stepSize=settings.step,
            regParam=settings.penalty, initStd=0.05, seed=settings.seed,
        ).fit(sample)
    finally:
        sample.unpersist()
        scratch.drop("labelled")
    return Model(fitted.intercept, fitted.linear.toArray(), fitted.factors.toArray(), prior, metadata, settings)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Key, ``score`` (0 to 1) and ``predicted`` (1 from a score of ``least``) of each row.

    Whole texts count; a null text is empty, and empty texts are scored like all others. A
    model of rows with one class gives every row the share of that class. Rows that repeat
    come back as often, an empty table gives no rows, and other columns are not read.
    """
    if model.linear is None:
        return docs.select(F.col(key), F.lit(float(model.prior)).alias("score")).withColumn("predicted", (F.col("score") >= least).cast("int"))
    shared, places = docs.sparkSession.sparkContext.broadcast(model), len(model.metadata)
    kind = dict(docs.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        features = Features(places, model.settings)
        for batch in batches:
            numbers = zip(*(batch.column(2 + i).to_pylist() for i in range(places)), strict=True) if places else [()] * batch.num_rows
            raw = np.array([model.raw(*features.of(t.as_py() or "", list(x))) for t, x in zip(batch.column(1), numbers, strict=True)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(raw, -500, 500))))], ["key", "score"])

    rows = _narrow(docs, text, model.metadata, F.col(key).alias("key")).mapInArrow(work, f"key {kind}, score double")
    return rows.select(F.col("key").alias(key), "score", (F.col("score") >= least).cast("int").alias("predicted"))
