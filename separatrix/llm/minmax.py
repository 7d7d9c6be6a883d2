"""Near-duplicates by min-max hashing.

Each permutation gives two values of a signature, its least and its greatest hash, so half
the hashes are evaluated. Bands of four values propose links; sets confirm them. Small sets,
whose least and greatest are not independent, also meet by what is left of them without one
or two elements, which finds every link between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from separatrix.llm.components import components
from separatrix.llm.scratch import Scratch

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Members of a bucket that one task compares with as many others.
BLOCK = 256


@dataclass(frozen=True)
class Settings:
    """A pair at exactly 80 of 100 shares no band once in 310,000 with these bands, if its sets are large.

    Of a union of u elements with s shared, a permutation agrees in both values with
    probability s (s - 1) / (u (u - 1)), so smaller sets miss more often: once in 172,000 for
    a union of 15. Sets of up to ``small`` elements (13 at 80 of 100) miss no link among
    themselves.
    """

    words: int = 5  # words in a shingle
    least: int = 80  # a link needs least / of
    of: int = 100
    permutations: int = 48
    values: int = 4  # signature values in a band: least and greatest of two permutations
    seed: int = 1

    @property
    def small(self) -> int:
        """Linked sets of this size or less differ in two elements at most."""
        return -(-3 * self.of // (self.of - self.least)) - 2 if self.least < self.of else 0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sets of shingle digests (sorted uint64) of texts."""

    def __init__(self, settings: Settings):
        from xxhash import xxh3_64_intdigest

        self.size, self.digest = settings.words, xxh3_64_intdigest
        rng = np.random.default_rng(settings.seed)
        self.factors = rng.integers(0, 2**63, settings.words, np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, text: str | None) -> np.ndarray:
        # bytes.split() cuts at the six ASCII white space characters and nothing else.
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        hashes = np.fromiter(map(self.digest, words), np.uint64, len(words))
        n = min(self.size, len(words))
        total = np.zeros(len(words) - n + 1, np.uint64)
        for i in range(n):
            total += _mix(hashes[i : len(hashes) - n + 1 + i] + np.uint64(n)) * self.factors[i]
        return np.unique(_mix(total))


class Signatures:
    def __init__(self, settings: Settings):
        rng = np.random.default_rng(settings.seed + 1)
        n = settings.permutations
        self.flips = rng.integers(0, 2**64, (n, 1), np.uint64)
        self.factors = rng.integers(0, 2**63, (n, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.values = settings.values

    def of(self, elements: np.ndarray) -> np.ndarray:
        """Least and greatest value under each permutation, side by side."""
        least = np.full(len(self.flips), 2**64 - 1, np.uint64)
        greatest = np.zeros(len(self.flips), np.uint64)
        for start in range(0, len(elements), 4096):
            values = (elements[start : start + 4096] ^ self.flips) * self.factors
            np.minimum(least, values.min(axis=1), out=least)
            np.maximum(greatest, values.max(axis=1), out=greatest)
        return np.column_stack((least, greatest)).ravel()

    def bands(self, elements: np.ndarray) -> np.ndarray:
        """A digest of each band, its number included."""
        rows = self.of(elements).reshape(-1, self.values)
        out = np.arange(len(rows), dtype=np.uint64)
        for column in rows.T:
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
        return out.view(np.int64)


def subsets(elements: np.ndarray, settings: Settings) -> np.ndarray:
    """Digests of a small set, of it without each element and, where such sets can link, without each two.

    Two linked sets of up to ``settings.small`` elements share one of them: if one element is
    missing, the smaller set; if each has one of its own, what they share; if two are
    missing, the smaller set again.
    """
    n = len(elements)
    mixed = _mix(elements ^ np.uint64(0xD6E8FEB86659FD93))
    whole = mixed.sum(dtype=np.uint64)
    left = [np.array([whole]), whole - mixed]
    if settings.of * (n - 2) >= settings.least * n:
        first, second = np.triu_indices(n, 1)
        left.append(whole - mixed[first] - mixed[second])
    sizes = np.repeat(np.arange(n, n - len(left), -1), [len(part) for part in left]).astype(np.uint64)
    return np.unique(_mix(np.concatenate(left) * np.uint64(0x9E3779B97F4A7C15) + sizes)).view(np.int64)


def _digest(elements: np.ndarray) -> bytes | None:
    return hashlib.sha256(elements.tobytes()).digest()[:16] if len(elements) else None


def sketch(docs: DataFrame, key: str, text: str, settings: Settings, carried: tuple[str, ...] = ()) -> DataFrame:
    """``key, n, digest, bands`` and what is carried; texts without words have no digest and no bands."""
    kinds = dict(docs.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, signatures = Shingles(settings), Signatures(settings)
        for batch in batches:
            counts, digests, bands = [], [], []
            for content in batch.column(1):
                elements = shingles.of(content.as_py())
                counts.append(len(elements))
                digests.append(_digest(elements))
                buckets = signatures.bands(elements) if len(elements) else None
                bands.append(buckets if not 0 < len(elements) <= settings.small else np.concatenate((buckets, subsets(elements, settings))))
            columns = [pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[2:]], ["key", "n", "digest", "bands", *names])

    names = [f"carried_{i}" for i in range(len(carried))]
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *(F.col(c).alias(n) for c, n in zip(carried, names, strict=True)))
    more = "".join(f", {n} {kinds[c]}" for c, n in zip(carried, names, strict=True))
    return narrow.mapInArrow(work, f"key {kinds[key]}, n long, digest binary, bands array<long>{more}")


def sets(docs: DataFrame, text: str, settings: Settings) -> DataFrame:
    """``digest, elements`` of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(settings)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                found = [shingles.of(t.as_py()) for t in batch.slice(start, 500).column(0)]
                columns = [pa.array([_digest(x) for x in found], pa.binary()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "elements"])

    return docs.select(text).mapInArrow(work, "digest binary, elements array<long>")


def confirm(pairs: DataFrame, elements: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = elements.select(F.col("key").alias("a"), F.col("elements").alias("x"))
    right = elements.select(F.col("key").alias("b"), F.col("elements").alias("y"))
    # Sets whose sizes differ too much need no look at their elements.
    both = pairs.join(right, "b").join(left, "a")
    near = F.least(F.size("x"), F.size("y")) * settings.of >= F.greatest(F.size("x"), F.size("y")) * settings.least
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared
    return both.filter(near).filter(shared * settings.of >= union * settings.least).select("a", "b")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set on the left with every set on the right."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    rows = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    a, b = np.concatenate(left), np.concatenate(right)
    # Only elements of both sides count; each becomes a column, a few thousand at a time.
    known = np.intersect1d(a, b)
    spots = [np.searchsorted(known, x) for x in (a, b)]
    kept = [(s < len(known)) & (known[np.minimum(s, len(known) - 1)] == x) if len(known) else np.zeros(len(x), bool) for s, x in zip(spots, (a, b), strict=True)]
    for start in range(0, len(known), 4096):
        tables = []
        for row, spot, keep, count in zip(rows, spots, kept, out.shape, strict=True):
            here = keep & (spot >= start) & (spot < start + 4096)
            table = np.zeros((count, min(4096, len(known) - start)), np.float32)
            table[row[here], spot[here] - start] = 1.0
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def _rest(shared: DataFrame, known: DataFrame, elements: DataFrame, settings: Settings) -> DataFrame:
    """Links within buckets between members that the first round left apart.

    A bucket's first member has met all others. Of the rest, members outside the component
    that the most of them share meet all members, in blocks of bounded size.
    """
    # Members that have no component yet are one by themselves.
    placed = shared.filter("key <> first").join(known, F.col("key") == F.col("node"), "left")
    placed = placed.select("bucket", "key", F.coalesce("component", "key").alias("component"))
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("strangers"),
        F.count(F.lit(1)).alias("parts"),
    ).filter("parts > 1")
    rows = placed.join(mixed, "bucket")
    alien = F.col("component") != F.col("main")
    spot = lambda n: F.pmod(F.xxhash64("key"), F.ceil(F.col(n) / BLOCK)).cast("int")
    blocks = lambda n: F.sequence(F.lit(0), (F.ceil(F.col(n) / BLOCK) - 1).cast("int"))
    # A group is a block of strangers with a block of all members.
    strangers = rows.filter(alien).select("*", spot("strangers").alias("i"), F.explode(blocks("n")).alias("j"), F.lit(True).alias("asks"))
    members = rows.select("*", F.explode(blocks("strangers")).alias("i"), spot("n").alias("j"), F.lit(False).alias("asks"))
    names = ["bucket", "i", "j", "key", "component", "asks"]
    groups = strangers.select(*names).union(members.select(*names)).join(elements, "key")
    kind = dict(shared.dtypes)["key"]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy(bool)
        left, right = group[asks], group[~asks]
        common = _common(list(left["elements"]), list(right["elements"]))
        a, b = (side["elements"].map(len).to_numpy()[:, None] for side in (left, right))
        near = common * settings.of >= (a + b.T - common) * settings.least
        near &= left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :]
        found, parent = [], {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        keys, others = left["key"].to_numpy(), right["key"].to_numpy()
        mine, theirs = left["component"].to_numpy(), right["component"].to_numpy()
        for n, m in zip(*np.nonzero(near), strict=True):
            # One link between two components is enough.
            if root(mine[n]) != root(theirs[m]):
                parent[root(mine[n])] = root(theirs[m])
                found.append((keys[n], others[m]))
        return pd.DataFrame(found, columns=["a", "b"])

    return groups.groupBy("bucket", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings(), carried: tuple[str, ...] = ()
) -> DataFrame:
    """One row for each row of ``docs``: key, ``n_shingles``, ``component_id``, ``kept``, and the ``carried`` columns.

    Words are what is between ASCII white space, with A to Z lower-cased. A text with fewer
    words than a shingle is one shingle; a text that is null or has no words links with
    nothing. ``component_id`` is the least key reachable by links of ``least / of`` or more,
    the row's own included, and that row is ``kept``. Rows that repeat come back as often.
    Each row counts by its own text: rows of one key with several texts may be in different
    components. A row with a null key has the component of rows with an equal set, if there
    are any with a key, and is not kept then; else it is its own component and is kept.
    """
    scratch = Scratch(docs.sparkSession)
    # Rows are numbered once and stored, so keys may be missing or repeat.
    numbered = sketch(docs, key, text, settings, carried).withColumn("node", F.monotonically_increasing_id())
    sketches = scratch.keep(numbered, "sketches")
    # Equal sets are one class from here on, so copies never meet each other.
    classes = sketches.filter("digest is not null and key is not null").groupBy("digest").agg(F.min("node").alias("class"), F.min("key").alias("least"))
    classes = scratch.keep(classes, "classes")
    extra = [f"carried_{i}" for i in range(len(carried))]
    members = scratch.keep(sketches.select("key", "n", "digest", *extra).join(classes, "digest", "left").drop("digest"), "members")
    heads = classes.select(F.col("class").alias("node"))
    entries = sketches.select("node", "bands").join(heads, "node", "left_semi").select(F.col("node").alias("key"), F.explode("bands").alias("bucket")).distinct()
    full = entries.groupBy("bucket").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = scratch.keep(entries.join(full.drop("n"), "bucket"), "buckets")

    # Stored, so that Spark knows the size of what it joins the texts with.
    wanted = scratch.keep(classes.join(shared.select(F.col("key").alias("class")).distinct(), "class", "left_semi"), "wanted")
    texts = docs.select(key, text).join(wanted.select(F.col("least").alias(key)).distinct(), key, "left_semi")
    # A key with several texts brings all of them; digests tell which one is meant. Sets move once.
    elements = sets(texts, text, settings).dropDuplicates(["digest"]).join(wanted.select("digest", F.col("class").alias("key")), "digest")
    elements = scratch.keep(elements.select("key", "elements"), "sets")
    pairs = shared.filter("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b")).distinct()
    links = scratch.keep(confirm(pairs, elements, settings), "links")
    known = scratch.keep(components(links, scratch), "components")
    more = scratch.keep(_rest(shared, known, elements, settings), "more-links")
    if not more.isEmpty():
        every = known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
        known = scratch.keep(components(every, scratch), "components")
    scratch.drop("sketches", "wanted", "buckets", "sets", "links", "more-links", "edges")

    # The least key of each component of several classes.
    joined = known.union(known.select(F.col("component").alias("node"), "component").distinct())
    first = joined.join(classes.select(F.col("class").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    placed = members.join(joined.join(first, "component").select("node", "component_id"), F.col("class") == F.col("node"), "left")
    component = F.coalesce("component_id", "least", "key")
    return placed.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("key")).alias("kept"),
        *(F.col(n).alias(c) for n, c in zip(extra, carried, strict=True)),
    )
