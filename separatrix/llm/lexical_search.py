"""Ranked lexical search by block-max MaxScore over shards of an inverted index.

A shard is what one task indexes in one go: for each term, blocks of postings with packed
documents and counts, and for each block the pairs of count and document length that no
other posting of the block dominates. From these the largest contribution of a block follows
exactly for any statistics of the whole table, without unpacking it.

A search adds up lists in windows of documents. Lists whose bounds together stay below the
k-th score so far are not essential: a document that occurs in those only cannot get in.
Candidates come from the essential lists; block maxima of the other lists reject most of
them before a block is unpacked. The best of the shards are merged.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from separatrix.llm.scratch import Scratch

# ASCII letters (A to Z lower-cased), digits and all bytes of other characters make terms; the rest is white space.
BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


@dataclass(frozen=True)
class Settings:
    """Score of a term: weight * (scale * tf div (1000 * tf + 12 * m)), m = 75 + 25 * n * N div L."""

    portion: int = 1_500_000  # terms, with repeats, in a shard
    block: int = 128  # postings in a block
    window: int = 4096  # documents that a search looks at together
    query_terms: int = 200_000  # terms of items that are searched in one job
    scale: int = 1_000_000_000


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(BYTES).split()


def contribution(tf: np.ndarray, n: np.ndarray, documents: int, total: int, settings: Settings) -> np.ndarray:
    """What a posting adds to a score for weight 1; grows with tf and falls with the length n."""
    m = 75 + (25 * n * documents) // total
    return (settings.scale * tf) // (1000 * tf + 12 * m)


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


class Shard:
    """Terms and documents of one task until they are written."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.keys, self.lengths, self.tokens, self.held = [], [], [], 0

    def add(self, key: object, found: list[bytes]) -> None:
        self.keys.append(key)
        self.lengths.append(len(found))
        self.tokens.append(np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found)))
        self.held += len(found)

    def rows(self, shard: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """One row of documents, then the blocks by term and document."""
        size, lengths = len(self.keys), np.array(self.lengths, np.int64)
        yield self._batch(shard, kind, {"n": [size], "total": [int(lengths.sum())], "keys": [pa.array(self.keys, kind)], "lengths": [lengths]})
        wide = np.concatenate(self.tokens) * size + np.repeat(np.arange(size), lengths)
        pairs, tf = np.unique(wide, return_counts=True)
        term, doc = pairs // size, pairs % size
        new = np.concatenate(([True], term[1:] != term[:-1]))
        begin = np.flatnonzero(new)
        place = np.arange(len(term)) - np.repeat(begin, np.diff(np.append(begin, len(term))))
        first = np.flatnonzero(place % self.settings.block == 0)
        many = np.diff(np.append(first, len(term)))
        block = np.repeat(np.arange(len(first)), many)
        inner = np.arange(len(term)) - first[block]
        gaps = np.where(inner == 0, 0, np.diff(doc, prepend=0))
        names = pa.array(list(self.numbers), pa.binary()).cast(pa.string()).take(pa.array(term[first]))

        # Packed gaps, then packed counts, in as many bytes as the largest of a block takes.
        gap_width, tf_width = _width(np.maximum.reduceat(gaps, first)), _width(np.maximum.reduceat(tf, first))
        ends = np.cumsum(many * (gap_width + tf_width))
        offsets = np.concatenate(([0], ends))
        packed = np.zeros(offsets[-1], np.uint8)
        at = offsets[block]
        spots = ((gaps, at + inner * gap_width[block], gap_width), (tf, at + (many * gap_width)[block] + inner * tf_width[block], tf_width))
        for values, spot, width in spots:
            for byte in range(4):
                has = width[block] > byte
                packed[spot[has] + byte] = (values[has] >> (8 * byte)) & 255

        # By falling count, a posting counts if its document is shorter than all before it in its block.
        n = lengths[doc]
        order = np.lexsort((n, -tf, block))
        step = np.int64(lengths.max() + 1)
        low = n[order] - block[order] * step
        before = np.concatenate(([step], np.minimum.accumulate(low)[:-1]))
        best = order[low < before]
        peaks = np.concatenate(([0], np.cumsum(np.bincount(block[best], minlength=len(first)))))

        for start in range(0, len(first), 100_000):
            end = min(len(first), start + 100_000)
            part, sky = slice(start, end), best[peaks[start] : peaks[end]]
            borders = pa.array((peaks[start : end + 1] - peaks[start]).astype(np.int32))
            cuts = (offsets[start : end + 1] - offsets[start]).astype(np.int32)
            data = packed[offsets[start] : offsets[end]]
            columns = {
                "term": names.slice(start, end - start), "first": doc[first[part]], "last": doc[first[part] + many[part] - 1], "n": many[part],
                "gap_width": gap_width[part], "tf_width": tf_width[part],
                "peak_tf": pa.ListArray.from_arrays(borders, pa.array(tf[sky])), "peak_n": pa.ListArray.from_arrays(borders, pa.array(n[sky])),
                "postings": pa.Array.from_buffers(pa.binary(), end - start, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())]),
            }
            yield self._batch(shard, kind, columns)

    @staticmethod
    def _batch(shard: int, kind: pa.DataType, columns: dict) -> pa.RecordBatch:
        fields = {
            "shard": pa.int64(), "term": pa.string(), "first": pa.int64(), "last": pa.int64(), "n": pa.int64(), "gap_width": pa.int32(),
            "tf_width": pa.int32(), "peak_tf": pa.list_(pa.int64()), "peak_n": pa.list_(pa.int64()), "postings": pa.binary(),
            "total": pa.int64(), "keys": pa.list_(kind), "lengths": pa.list_(pa.int64()),
        }
        rows = len(next(iter(columns.values())))
        arrays = []
        for name, dtype in fields.items():
            if name == "shard":
                arrays.append(pa.array(np.full(rows, shard)))
            elif name == "keys" and name in columns:
                keys = columns[name][0]
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys))
            elif name not in columns:
                arrays.append(pa.nulls(rows, dtype))
            else:
                values = columns[name]
                arrays.append(values if isinstance(values, pa.Array) and values.type == dtype else pa.array(values, dtype))
        return pa.RecordBatch.from_arrays(arrays, list(fields))


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The index of all rows: for each shard a row of its documents (``term`` null), and its blocks.

    Texts that are null or have no term are in no shard. Nothing is shuffled: a shard is a
    stretch of the rows that one task reads. The result must be stored before it is
    searched, so that numbers of documents hold.
    """
    kind = dict(docs.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = Shard(settings), TaskContext.get().partitionId() << 32
        for batch in batches:
            keys = batch.column(0)
            for whose, content in zip(keys, batch.column(1), strict=True):
                if found := terms(content.as_py()):
                    shard.add(whose.as_py(), found)
                if shard.held >= settings.portion:
                    yield from shard.rows(number, keys.type)
                    shard, number = Shard(settings), number + 1
        if shard.keys:
            yield from shard.rows(number, keys.type)

    schema = (
        "shard long, term string, first long, last long, n long, gap_width int, tf_width int, peak_tf array<long>, peak_n array<long>, "
        f"postings binary, total long, keys array<{kind}>, lengths array<long>"
    )
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, schema)


class ShardSearch:
    """Searches one shard; blocks are unpacked once, and only those that a query needs."""

    def __init__(self, documents: pa.Table, blocks: pa.Table, statistics: tuple[int, int], settings: Settings):
        self.settings, self.statistics = settings, statistics
        keys = documents.column("keys").combine_chunks().flatten()
        self.keys, self.lengths = keys, documents.column("lengths").combine_chunks().flatten().to_numpy()
        # Ties go to the smaller key; rows without one come last.
        self.order = np.empty(len(keys), np.int64)
        self.order[pc.array_sort_indices(keys, order="ascending", null_placement="at_end").to_numpy()] = np.arange(len(keys))
        blocks = blocks.sort_by([("term", "ascending"), ("first", "ascending")])
        numbers = {c: blocks.column(c).to_numpy() for c in ("first", "last", "n", "gap_width", "tf_width")}
        self.first, self.last, self.n, self.gap_width, self.tf_width = numbers.values()
        self.postings = blocks.column("postings")
        self.lists: dict[str, slice] = {}
        names = blocks.column("term").to_pylist()
        for at, name in enumerate(names):
            known = self.lists.get(name)
            self.lists[name] = slice(at if known is None else known.start, at + 1)
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if names:
            peaks = [blocks.column(c).combine_chunks() for c in ("peak_tf", "peak_n")]
            values = contribution(*(p.flatten().to_numpy() for p in peaks), *statistics, settings)
            starts = np.concatenate(([0], np.cumsum(pc.list_value_length(peaks[0]).to_numpy())[:-1]))
            self.peak = np.maximum.reduceat(values, starts)

    def unpack(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and contributions for weight 1 of one block."""
        if block not in self.unpacked:
            data, n = self.postings[block].as_py(), int(self.n[block])
            gap_width, tf_width = self.gap_width[block], self.tf_width[block]
            docs = np.cumsum(np.frombuffer(data, f"<u{gap_width}", n), dtype=np.int64) + self.first[block]
            tf = np.frombuffer(data, f"<u{tf_width}", n, offset=n * gap_width).astype(np.int64)
            self.unpacked[block] = docs, contribution(tf, self.lengths[docs], *self.statistics, self.settings)
        return self.unpacked[block]

    def _add(self, into: np.ndarray, low: int, part: slice, weight: int, only: np.ndarray | None = None) -> None:
        """Add what a list's blocks give to the documents from ``low`` on."""
        for block in range(part.start, part.stop) if only is None else only:
            docs, values = self.unpack(int(block))
            start, end = np.searchsorted(docs, (low, low + len(into)))
            into[docs[start:end] - low] += weight * values[start:end]

    def best(self, weights: list[tuple[str, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the ``k`` best with a score above 0."""
        lists = [(self.lists[t], w) for t, w in weights if w > 0 and t in self.lists]
        lists = sorted(((int(self.peak[part].max()) * w, part, w) for part, w in lists), key=lambda x: x[0])
        bounds = np.cumsum([bound for bound, _, _ in lists])
        found, scores, threshold = np.empty(0, np.int64), np.empty(0, np.int64), 1
        if not lists:
            return found, scores
        for low in range(0, len(self.lengths), self.settings.window):
            total = np.zeros(min(self.settings.window, len(self.lengths) - low), np.int64)
            # The lists below this place cannot bring a document in by themselves.
            essential = int(np.searchsorted(bounds, threshold))
            if essential == len(lists):
                break
            in_window = []
            for _, part, _ in lists:
                start = part.start + int(np.searchsorted(self.last[part], low))
                end = part.start + int(np.searchsorted(self.first[part], low + len(total)))
                in_window.append(slice(start, end))
            for (_, _, weight), part in zip(lists[essential:], in_window[essential:], strict=True):
                self._add(total, low, part, weight)
            open_docs = np.flatnonzero(total)
            for n in range(essential - 1, -1, -1):
                open_docs = open_docs[total[open_docs] + bounds[n] >= threshold]
                if not len(open_docs):
                    break
                part, weight, lower = in_window[n], lists[n][2], int(bounds[n - 1]) if n else 0
                if part.start >= part.stop:
                    continue
                # The block that would hold each candidate, and the most it could add.
                block = part.start + np.searchsorted(self.first[part], open_docs + low, side="right") - 1
                inside = (block >= part.start) & (self.last[np.maximum(block, 0)] >= open_docs + low)
                most = np.where(inside, self.peak[np.maximum(block, 0)] * weight, 0)
                stay = total[open_docs] + most + lower >= threshold
                open_docs, wanted = open_docs[stay], np.unique(block[stay & inside])
                if len(wanted):
                    added = np.zeros(len(total), np.int64)
                    self._add(added, low, part, weight, wanted)
                    total[open_docs] += added[open_docs]
            open_docs = open_docs[total[open_docs] >= threshold]
            if len(open_docs):
                found, scores = np.append(found, open_docs + low), np.append(scores, total[open_docs])
                top = np.lexsort((self.order[found], -scores))[:k]
                found, scores = found[top], scores[top]
                if len(found) == k:
                    threshold = max(1, int(scores[-1]))
        return found, scores


def asked(items: DataFrame, key: str, text: str) -> DataFrame:
    """``query`` (a number for each row), ``item``, ``term`` and ``times`` of the rows' terms."""
    kind = dict(items.dtypes)[key]
    numbered = items.select(F.monotonically_increasing_id().alias("query"), F.col(key).alias("item"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names, times = [], [], []
            for n, content in enumerate(batch.column(2)):
                for term, often in Counter(terms(content.as_py())).items():
                    at.append(n), names.append(term), times.append(often)
            rows = pa.array(at, pa.int64())
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(names, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["query", "item", "term", "times"])

    return numbered.mapInArrow(work, f"query long, item {kind}, term string, times long")


def _searcher(shared: Broadcast, statistics: tuple[int, int], k: int, settings: Settings) -> Callable[[pa.Table], pa.Table]:
    """Searches one shard for the queries of ``shared``: their terms and weights."""

    def work(table: pa.Table) -> pa.Table:
        is_block = pc.is_valid(table.column("term"))
        here = ShardSearch(table.filter(pc.invert(is_block)), table.filter(is_block), statistics, settings)
        queries, found, scores = [], [np.empty(0, np.int64)], []
        for query, weights in shared.value.items():
            docs, values = here.best(weights, k)
            queries += [query] * len(docs)
            found.append(docs)
            scores += values.tolist()
        keys = here.keys.take(pa.array(np.concatenate(found)))
        return pa.table({"query": pa.array(queries, pa.int64()), "key": keys, "score": pa.array(scores, pa.int64())})

    return work


def search(index: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", k: int = 20, settings: Settings = Settings()) -> DataFrame:
    """``query, item, rank, key, score``: the ``k`` best documents for each row of ``items``.

    Scores are whole numbers and above 0; equal ones go by key, rows without a key last. Each
    row of ``items`` is a query by itself, so rows that repeat get their results each; a
    text that is null or has no known term gets none, and so does every text of an empty
    index. Items are searched in blocks of ``query_terms`` terms, which bounds what is sent
    to tasks (an item is not cut).
    """
    scratch = Scratch(index.sparkSession)
    documents, blocks = index.filter("term is null"), index.filter("term is not null")
    totals = documents.agg(F.sum("n").alias("documents"), F.sum("total").alias("total")).first()
    size, total = totals["documents"] or 0, totals["total"] or 0
    wanted = scratch.keep(asked(items, key, text), "asked")
    df = blocks.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * size + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0))))
    weights = scratch.keep(wanted.join(df, "term").select("query", "item", "term", (weight * F.col("times")).cast("long").alias("weight")), "weights")
    kinds = dict(index.dtypes)["keys"].removeprefix("array<").removesuffix(">"), dict(weights.dtypes)["item"]
    schema = f"query long, key {kinds[0]}, score long"
    turns = max(1, -(-weights.count() // settings.query_terms))
    heaps = None
    for turn in range(turns):
        mine = weights.filter(F.pmod(F.xxhash64("query"), F.lit(turns)) == turn)
        lists = defaultdict(list)
        for row in mine.select("query", "term", "weight").toLocalIterator():
            lists[row["query"]].append((row["term"], row["weight"]))
        work = _searcher(index.sparkSession.sparkContext.broadcast(dict(lists)), (size, total), k, settings)
        needed = blocks.join(mine.select("term").distinct(), "term", "left_semi").select(*index.columns)
        best = needed.union(documents).groupBy("shard").applyInArrow(work, schema)
        heaps = best if heaps is None else heaps.union(best)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    merged = heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = weights.select("query", "item").distinct()
    return merged.join(names, "query").select("query", "item", "rank", "key", "score")
