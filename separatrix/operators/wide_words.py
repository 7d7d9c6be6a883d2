"""The library's logistic classifier on counts of all words, without a list or a vector of words.

``estimators.word_logistic`` keeps the vocabulary and some twenty dense vectors of its length
in the driver. Here words stay in the tasks. The optimizer is the library's (L-BFGS with a
strong Wolfe search, on centred features of unit variance), and every vector it makes is a
combination of ``X' e_0, X' e_1, ...``, where ``e_k`` are the rows' errors after step k. So a
vector is its few coefficients, dot products follow from the matrix ``e_i' X X' e_j``, and a
search along a line needs the rows' margins only. A step costs one product ``X X' e``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from separatrix.functions.text import exploded, with_token_runs
from separatrix.functions.vectors import link
from separatrix.operators.tables import INTERCEPT
from separatrix.storage import materialize, parallelism

# Counts of one group of words, which a task holds.
GROUP_COUNTS = 2_000_000
# The library's settings: pairs of the optimizer's memory, tolerance, steps of a line search.
MEMORY, TOLERANCE, SEARCHES = 10, 1e-6, 10
# Decrease and curvature that a step must have.
DECREASE, CURVATURE = 1e-4, 0.9


@dataclass
class WideWordModel:
    """``weights`` has ``(word, df, value)`` for each word of the training rows."""

    intercept: float
    weights: DataFrame

    def coefficients(self) -> DataFrame:
        """``(idx, name, value)``, intercept first, then by document frequency and word."""
        spark = self.weights.sparkSession
        ordered = self.weights.orderBy(F.desc("df"), "word")
        # Partitions are in order and so are their rows; only partition sizes are fetched.
        placed = materialize(ordered.select("word", "value", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")), "placed-words")
        placed = placed.withColumn("_r", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
        sizes, before = {}, 1
        for p, n in sorted(tuple(r) for r in placed.groupBy("_p").count().collect()):
            sizes[p], before = before, before + n
        starts = spark.createDataFrame(list(sizes.items()), "_p int, _start long")
        words = placed.join(F.broadcast(starts), "_p").select((F.col("_start") + F.col("_r")).cast("int").alias("idx"), F.col("word").alias("name"), "value")
        first = spark.range(1).select(F.lit(0).alias("idx"), F.lit(INTERCEPT).alias("name"), F.lit(self.intercept).alias("value"))
        return first.unionByName(words)

    def with_outputs(self, df: DataFrame, tokens: str) -> DataFrame:
        """Add ``margin``, ``probability_pos`` and ``prediction_class``; unknown words count nothing."""
        rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "rows-to-score")
        sums = _counts(rows, tokens).join(self.weights, "word").groupBy("_row").agg(F.sum(F.col("n") * F.col("value")).alias("_s"))
        margin = F.coalesce("_s", F.lit(0.0)) + F.lit(self.intercept)
        scored = rows.join(sums, "_row", "left").withColumn("margin", margin).drop("_row", "_s")
        return scored.withColumns({"probability_pos": link("margin"), "prediction_class": F.when(F.col("margin") > 0, 1).otherwise(-1)})


def _counts(rows: DataFrame, tokens: str) -> DataFrame:
    """``(_row, word, n)``, one row per distinct word of a row."""
    runs = with_token_runs(rows, F.col(tokens)).select("_row", F.arrays_zip("_words", "_counts").alias("p"))
    return exploded(runs, "p").select("_row", F.col("p._words").alias("word"), F.col("p._counts").alias("n"))


def _columns(n: int) -> Callable[[pa.Table], pa.Table]:
    """Packs the counts of some words: one row with all of them, sorted by word."""

    def pack(group: pa.Table) -> pa.Table:
        coded = pc.dictionary_encode(group.column("word").combine_chunks())
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        words, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        count = group.column("n").to_numpy().astype(float)
        rows, row = np.unique(group.column("_row").to_numpy(), return_inverse=True)
        df, mean = np.bincount(word, minlength=len(words)), np.bincount(word, weights=count, minlength=len(words)) / n
        # Squared distances from the mean, of rows with the word and of those without.
        spread = np.bincount(word, weights=(count - mean[word]) ** 2, minlength=len(words)) + (n - df) * mean**2
        std = np.sqrt(spread / max(1, n - 1))
        inverse = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
        cells = {"words": words, "df": df, "mean": mean, "inverse": inverse, "rows": rows, "word": word, "row": row.astype(np.int32), "n": count.astype(np.int32)}
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        held = [pa.array([v if isinstance(v, pa.Array) else pa.array(v)], pa.list_(t)) for v, t in zip(cells.values(), kinds, strict=True)]
        return pa.table([group.column("part").combine_chunks().slice(0, 1), *held], names=["part", *cells])

    return pack


PACKED = "part int, words array<string>, df array<long>, mean array<double>, inverse array<double>, rows array<long>, word array<int>, row array<int>, n array<int>"


def _slopes(held: pa.Table, errors: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The arrays of a group of words, and ``X' e`` for them."""
    x = {c: held.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("mean", "inverse", "rows", "word", "row", "n")}
    by_row = np.argsort(errors.column("_row").to_numpy())
    known, e = errors.column("_row").to_numpy()[by_row], errors.column("e").to_numpy()[by_row]
    mine = e[np.searchsorted(known, x["rows"])]
    raw = np.bincount(x["word"], weights=x["n"] * mine[x["row"]], minlength=len(x["mean"]))
    # All errors come to each group, so their sum is the whole one.
    return x, x["inverse"] * (raw - x["mean"] * e.sum())


def _product(held: pa.Table, errors: pa.Table) -> pa.Table:
    """Rows' shares of ``X X' e`` from one group of words; what the means take from each row has no row."""
    if not held.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.float64())], names=["_row", "h"])
    x, slopes = _slopes(held, errors)
    scaled = x["inverse"] * slopes
    share = np.bincount(x["row"], weights=x["n"] * scaled[x["word"]], minlength=len(x["rows"]))
    rows = pa.concat_arrays([pa.array(x["rows"], pa.int64()), pa.nulls(1, pa.int64())])
    return pa.table([rows, pa.array(np.r_[share, -(x["mean"] * scaled).sum()])], names=["_row", "h"])


def _final(held: pa.Table, errors: pa.Table) -> pa.Table:
    """Weights of a group of words, and in a row without a word what they add to the intercept."""
    if not held.num_rows:
        return pa.table([pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["word", "df", "value"])
    x, slopes = _slopes(held, errors)
    value = x["inverse"] * slopes
    words, df = (held.column(c).combine_chunks().flatten() for c in ("words", "df"))
    return pa.table(
        [pa.concat_arrays([words, pa.nulls(1, pa.string())]), pa.concat_arrays([df, pa.nulls(1, pa.int64())]), pa.array(np.r_[value, -(x["mean"] * value).sum()])],
        names=["word", "df", "value"],
    )


def _log_loss(y: Column, margin: Column) -> Column:
    return F.greatest(margin, F.lit(0.0)) - y * margin + F.log1p(F.exp(-F.abs(margin)))


class _Rows:
    """Training rows with their errors ``e`` and ``h = X X' e`` of each step so far."""

    def __init__(self, stored: DataFrame, held: DataFrame, n: int, parts: int, penalty: float):
        self.state = stored.select("_row", "_y", *(F.array().cast("array<double>").alias(c) for c in ("e", "h")))
        self.held, self.n, self.parts, self.penalty = held, n, parts, penalty
        self.gram = np.zeros((0, 0))

    def _margin(self, c: np.ndarray, b: float) -> Column:
        terms = [F.lit(float(v)) * F.get("h", F.lit(k)) for k, v in enumerate(c) if v]
        return sum(terms, F.lit(float(b)))

    def _sent(self, errors: DataFrame) -> DataFrame:
        parts = F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))).alias("part")
        return errors.select("_row", "e", parts).groupBy("part")

    def dot(self, a: tuple[np.ndarray, float], b: tuple[np.ndarray, float]) -> float:
        return self.squares(a[0], b[0]) + a[1] * b[1]

    def squares(self, a: np.ndarray, b: np.ndarray) -> float:
        return float(a @ self.gram[: len(a), : len(b)] @ b)

    def along(self, x, d, t: float) -> tuple[float, float]:
        """Loss and slope at ``x + t d``."""
        size = max(len(x[0]), len(d[0]))
        w, step = (np.r_[v[0], np.zeros(size - len(v[0]))] for v in (x, d))
        margin, moved = self._margin(w + t * step, x[1] + t * d[1]), self._margin(step, d[1])
        at = self.state.select("_y", margin.alias("m"), moved.alias("d"))
        loss, slope = at.agg(F.sum(_log_loss(F.col("_y"), F.col("m"))), F.sum((link("m") - F.col("_y")) * F.col("d"))).first()
        now = w + t * step
        return loss / self.n + 0.5 * self.penalty * self.squares(now, now), slope / self.n + self.penalty * self.squares(now, step)

    def gradient(self, x) -> tuple[np.ndarray, float]:
        """The gradient at ``x``, for which the errors there become the next step's."""
        k = len(self.gram)
        error = (link(self._margin(*x)) - F.col("_y")) / F.lit(float(self.n))
        errors = self.state.select("_row", error.alias("e"))
        shares = self.held.groupBy("part").cogroup(self._sent(errors)).applyInArrow(_product, "_row long, h double")
        shares = shares.groupBy("_row").agg(F.sum("h").alias("h")).persist(StorageLevel.MEMORY_AND_DISK)
        shift = shares.filter("_row is null").select("h").first()
        shift = shift[0] if shift else 0.0
        mine = shares.filter("_row is not null").select("_row", F.col("h").alias("_h"))
        h = F.coalesce("_h", F.lit(0.0)) + F.lit(float(shift))
        joined = self.state.join(mine, "_row", "left")
        longer = joined.select("_row", "_y", F.array_append("e", error).alias("e"), F.array_append("h", h).alias("h"))
        self.state = materialize(longer, "wide-words-rows")
        shares.unpersist()
        last = F.get("h", F.lit(k))
        found = self.state.agg(F.sum(F.get("e", F.lit(k))), *(F.sum(F.get("e", F.lit(j)) * last) for j in range(k + 1))).first()
        gram = np.zeros((k + 1, k + 1))
        gram[:k, :k] = self.gram
        gram[k, :] = gram[:, k] = found[1:]
        self.gram = gram
        return np.r_[self.penalty * np.r_[x[0], np.zeros(k - len(x[0]))], 1.0], found[0]

    def weights(self, c: np.ndarray) -> DataFrame:
        combined = sum((F.lit(float(v)) * F.get("e", F.lit(k)) for k, v in enumerate(c)), F.lit(0.0))
        errors = self.state.select("_row", combined.alias("e"))
        return self.held.groupBy("part").cogroup(self._sent(errors)).applyInArrow(_final, "word string, df long, value double")


class _SearchFailed(Exception):
    pass


def _cubic(a: tuple, b: tuple) -> float:
    """Where the cubic through two ``(t, value, slope)`` is least, not too near either."""
    (lt, lv, ls), (rt, rv, rs) = (a, b) if a[0] <= b[0] else (b, a)
    d1 = ls + rs - 3 * (lv - rv) / (lt - rt)
    under = d1 * d1 - ls * rs
    d2 = math.sqrt(under) if under >= 0 else math.nan
    t = rt - (rt - lt) * (rs + d2 - d1) / (rs - ls + 2 * d2)
    low, high = lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)
    return low if t < low else high if t > high else t


def _search(at: Callable[[float], tuple[float, float]], start: tuple[float, float], t: float) -> float:
    """Step that satisfies the strong Wolfe conditions (Nocedal, Wright, 3.5)."""
    value, slope = start
    if slope > 0:
        raise _SearchFailed
    low = (0.0, value, slope)

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(SEARCHES):
            c = (t := _cubic(low, high), *at(t))
            if c[1] > value + DECREASE * t * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= CURVATURE * abs(slope):
                return t
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise _SearchFailed

    for i in range(SEARCHES):
        c = (t, *at(t))
        if not math.isfinite(c[1]):
            t /= 2.0
            continue
        if c[1] > value + DECREASE * t * slope or i and c[1] >= low[1]:
            return zoom(low, c)
        if abs(c[2]) <= CURVATURE * abs(slope):
            return t
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, 1.5 * t
    raise _SearchFailed


def _direction(rows: _Rows, g, pairs: list) -> tuple[np.ndarray, float]:
    """Minus the approximate inverse curvature times the gradient; ``pairs`` has the newest first."""
    size = len(rows.gram)

    def long(v) -> np.ndarray:
        return np.r_[v[0], np.zeros(size - len(v[0])), v[1]]

    def dot(a, b) -> float:
        return rows.dot((a[:-1], a[-1]), (b[:-1], b[-1]))

    out, steps = long(g), [(long(s), long(y)) for s, y in pairs]
    scale = dot(*steps[0]) / dot(steps[0][1], steps[0][1]) if steps else 1.0
    if scale < 0 or math.isnan(scale):
        raise _SearchFailed
    back = []
    for s, y in steps:
        back.append(dot(s, out) / dot(s, y))
        out = out - back[-1] * y
    out = scale * out
    for (s, y), a in zip(reversed(steps), reversed(back), strict=True):
        out = out + (a - dot(y, out) / dot(s, y)) * s
    return -out[:-1], -out[-1]


def _plus(a, b, times: float = 1.0) -> tuple[np.ndarray, float]:
    size = max(len(a[0]), len(b[0]))
    first, second = (np.r_[v[0], np.zeros(size - len(v[0]))] for v in (a, b))
    return first + times * second, a[1] + times * b[1]


def _minimize(rows: _Rows, intercept: float, max_iter: int) -> tuple[np.ndarray, float]:
    x = (np.zeros(0), intercept)
    value = rows.along(x, (np.zeros(0), 0.0), 0.0)[0]
    g, pairs, step, failed, seen, first = rows.gradient(x), [], 0, False, [math.inf], value
    while step < max_iter and math.sqrt(rows.dot(g, g)) > max(TOLERANCE * abs(value), 1e-8):
        if step and abs(value - max(seen)) <= TOLERANCE * abs(first):
            break
        try:
            d = _direction(rows, g, pairs)
            t = _search(lambda t: rows.along(x, d, t), (value, rows.dot(g, d)), 1.0 if step else 1.0 / math.sqrt(rows.dot(d, d)))  # noqa: B023
            if t * math.sqrt(rows.dot(g, g)) < 1e-10:
                raise _SearchFailed
        except _SearchFailed:
            # The library forgets what it knows of the curvature once, then gives up.
            if failed:
                break
            failed, pairs = True, []
            continue
        failed, step = False, step + 1
        moved = _plus(x, d, t)
        if step == max_iter:
            return moved
        value, before = rows.along(moved, d, 0.0)[0], g
        g = rows.gradient(moved)
        pairs = [(_plus(moved, x, -1.0), _plus(g, before, -1.0)), *pairs][:MEMORY]
        x, seen = moved, [*seen, value][-20:]
    return x


def fit_all_words(train: DataFrame, tokens: str, positive: Column, penalty: float = 0.01, max_iter: int = 10) -> WideWordModel:
    """Logistic classifier on the counts of all words, as ``estimators.word_logistic`` fits it.

    ``positive`` is 1.0 or 0.0 in each row; the loss is the mean over rows plus ``penalty / rows``
    half squares of the weights on unit variance. Null tokens are no words. Words come in groups
    of bounded size, whole columns each; a row sends its error to every group.
    """
    rows = materialize(train.select(F.monotonically_increasing_id().alias("_row"), F.col(tokens).alias("_t"), positive.alias("_y")), "wide-words")
    n, ones, counted = rows.agg(F.count("*"), F.sum("_y"), F.sum(F.size(F.array_distinct(F.coalesce("_t", F.array().cast("array<string>")))).cast("long"))).first()
    if not counted:
        raise ValueError("no words to fit")
    parts = max(parallelism(rows), -(-counted // GROUP_COUNTS))
    keyed = _counts(rows, "_t").withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int"))
    packed = materialize(keyed.groupBy("part").applyInArrow(_columns(n), PACKED), "wide-words-columns")
    if ones in (0, n):
        zero = packed.select(F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("df").alias("df")))).withColumn("value", F.lit(0.0))
        return WideWordModel(math.inf if ones else -math.inf, zero)
    # Dealt out once: each step finds the groups where they are.
    held = packed.repartition(parts, "part").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        state = _Rows(rows, held, n, parts, penalty / n)
        state.state = materialize(state.state, "wide-words-rows")
        c, intercept = _minimize(state, math.log(ones / (n - ones)), max_iter)
        found = materialize(state.weights(c), "wide-words-weights")
    finally:
        held.unpersist()
    shift = found.filter("word is null").agg(F.sum("value")).first()[0] or 0.0
    return WideWordModel(intercept + shift, found.filter("word is not null"))
