"""Periodic runs of words by seeds on diagonals.

A run of period q repeats itself q words later, so it is a stretch of equal words on the
diagonal of lag q. Stretches of that length hold a seed, a k-gram of words that occurs
again q words on. Seeds are found by sorting hashed k-grams of one document, extended word
by word, and what a lag has covered already is not extended again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
# Words whose results a task holds before it passes them on.
PORTION = 1_000_000


@dataclass(frozen=True)
class Settings:
    """A run has at least ``least`` words and ``times`` periods (2 or more)."""

    least: int = 24
    times: int = 3

    def overlap(self, period: int) -> int:
        """Least length of the stretch on the diagonal of a run with that period."""
        return max(self.least - period, (self.times - 1) * period)

    def guaranteed(self) -> int:
        """The stretch that every run has at least, whatever its period."""
        return min(self.overlap(q) for q in range(1, max(2, self.least) + 1))


def _power(n: int) -> int:
    """Largest power of two that is not above n."""
    return 1 << (max(1, n).bit_length() - 1)


class Grams:
    """Hashes of k-grams for growing powers of two k; equal k-grams have equal hashes."""

    def __init__(self, hashes: np.ndarray):
        self.levels = [hashes.astype(np.uint64)]

    def of(self, k: int) -> np.ndarray:
        while 1 << (len(self.levels) - 1) < k:
            # A gram of twice the words is one gram and the one behind it.
            half, values = 1 << (len(self.levels) - 1), self.levels[-1]
            wide = values[:-half] * np.uint64(0x9E3779B97F4A7C15) + values[half:]
            wide ^= wide >> np.uint64(31)
            self.levels.append(wide * np.uint64(0xBF58476D1CE4E5B9))
        return self.levels[k.bit_length() - 1]


def _extend(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch of places x around ``at`` with words[x] == words[x + lag]."""
    n, end, size = len(words) - lag, at, 64
    while end < n:
        stop = min(n, end + size)
        same = words[end:stop] == words[end + lag : stop + lag]
        if not same.all():
            end += int(same.argmin())
            break
        end, size = stop, size * 2
    start, size = at, 64
    while start > 0:
        stop = max(0, start - size)
        same = (words[stop:start] == words[stop + lag : start + lag])[::-1]
        if not same.all():
            start -= int(same.argmin())
            break
        start, size = stop, size * 2
    return start, end


def _pairs(grams: np.ndarray, step: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i (multiples of ``step``) and lags low <= d < high with equal grams at i and i + d."""
    n = len(grams)
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    rank = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
    # Rank and place in one number; a lag added to a place stays within its rank.
    wide = np.int64(n + high + 1)
    keys = rank * wide + order
    mine = np.empty(n, np.int64)
    mine[order] = rank * wide
    anchors = np.arange(0, n, step)
    first = np.searchsorted(keys, mine[anchors] + anchors + low)
    last = np.searchsorted(keys, mine[anchors] + anchors + high)
    counts = last - first
    i = np.repeat(anchors, counts)
    inner = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
    return i, order[np.repeat(first, counts) + inner] - i


def find_runs(words: np.ndarray, settings: Settings = Settings(), hashes: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of every run, by start and period.

    ``words`` are numbers, equal for equal words only; ``hashes`` (by default the words
    themselves) are 64-bit values that are equal for equal words. Lags are taken in classes
    from Q to 2Q. In a class every run holds a seed of about Q words at one of the places
    that are multiples of about Q, and such a place has at most Q partners, so a class has
    no more pairs than the text has words.
    """
    n = len(words)
    runs: dict[tuple[int, int], int] = {}
    grams = Grams(words if hashes is None else hashes)
    least = settings.guaranteed()
    low, high = 1, max(2, least)
    while low * settings.times <= n and n >= settings.least:
        # Seeds of all places in the first class, then longer ones at some places.
        shortest = least if low == 1 else (settings.times - 1) * low
        k = _power(shortest) if low == 1 else _power((shortest + 1) // 2)
        if n < k + low:
            break
        values = grams.of(k)
        if len(np.unique(values)) == len(values):
            break  # longer seeds cannot repeat either
        i, lags = _pairs(values, shortest - k + 1, low, min(high, n))
        # Inside a known run, lags that are multiples of its period lead back to it.
        for (start, end), period in runs.items():
            part = slice(*np.searchsorted(i, (start, end)))
            known = (i[part] + lags[part] + k <= end) & (lags[part] % period == 0)
            if known.any():
                stay = np.ones(len(i), bool)
                stay[part] = ~known
                i, lags = i[stay], lags[stay]
        order = np.lexsort((i, lags))
        i, lags = i[order], lags[order]
        borders = np.concatenate(([0], np.flatnonzero(np.diff(lags)) + 1, [len(lags)]))
        for first, last in zip(borders[:-1], borders[1:], strict=True):
            if first == last:
                continue
            lag, places, at = int(lags[first]), i[first:last], 0
            while at < len(places):
                start, covered = _extend(words, int(places[at]), lag)
                if covered - start >= settings.overlap(lag):
                    # The same stretch with a smaller period came first.
                    runs.setdefault((start, covered + lag), lag)
                at = max(at + 1, int(np.searchsorted(places, covered)))
        low, high = high, 2 * high
    return sorted((s, e - s, q) for (s, e), q in runs.items())


def text_words(text: str | None) -> list[bytes]:
    """What is between ASCII white space; bytes.split() cuts at those six characters only."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def runs_of(words: list[bytes], settings: Settings) -> list[tuple[int, int, int]]:
    if len(words) < settings.least:
        return []
    hashes = np.fromiter(map(hash, words), np.int64, len(words))
    # Most texts have no repeated seed, and need no exact numbers of words.
    first = Grams(hashes).of(_power(settings.guaranteed()))
    if len(np.unique(first)) == len(first):
        return []
    known: dict[bytes, int] = {}
    exact = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return find_runs(exact, settings, hashes)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words but for those that a run holds after its first period, joined by one space."""
    if runs:
        stay = np.ones(len(words), bool)
        for start, length, period in runs:
            stay[start + period : start + length] = False
        words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Key, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed`` of each row.

    Runs are maximal, starts count words from 0, and periods are the smallest ones. A text
    that is null, empty or white space has no words, no runs and an empty collapsed text.
    Rows that repeat, and rows without a key, come back as often; an empty table gives no
    rows, and no other columns are read. A text is worked on whole in one task, with memory
    in proportion to its words.
    """
    kind = dict(docs.dtypes)[key]

    def table(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        at, counts, found, texts = zip(*rows, strict=True)
        flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
        offsets = np.concatenate(([0], np.cumsum([len(runs) for runs in found]))).astype(np.int32)
        steps = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], ["start", "length", "period"])
        columns = [keys.take(pa.array(at)), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), steps), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["key", "n_words", "runs", "collapsed"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for n, content in enumerate(batch.column(1)):
                words = text_words(content.as_py())
                runs = runs_of(words, settings)
                rows.append((n, len(words), runs, collapsed(words, runs)))
                held += len(words)
                if held >= PORTION:
                    yield table(batch.column(0), rows)
                    rows, held = [], 0
            if rows:
                yield table(batch.column(0), rows)

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return narrow.mapInArrow(work, f"key {kind}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("key", key)
