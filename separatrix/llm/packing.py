"""Best-fit packing of documents into sequences, certified by lower bounds.

Pieces are dealt out to partitions by digest. Each partition packs its own by best-fit
decreasing and bounds the number of sequences from below by dual-feasible functions. Where
the bound is met, no packing of those pieces is better. The other partitions put together
what is in their unfilled sequences, deal it out anew and pack again.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from separatrix.llm.scratch import Scratch

# Tokens in a sequence, and pieces that one partition packs, with their ids if they carry any.
CAPACITY = 2048
PIECES = 20_000
# Most exchanges between partitions.
EXCHANGES = 3
# Tokens that a task holds before it passes them on.
PORTION = 2_000_000


class Tokenizer:
    """Ids of a byte-level BPE vocabulary in the JSON format of the tokenizers library.

    The merges of such a file are in the order of ranks, which is all that the faster
    tiktoken needs to give the same ids. ``encode_special_tokens`` is the library's setting
    of that name: if true, the strings of added tokens are ordinary text; if false, which is
    the library's default, each is found in a text and gets its own id.
    """

    def __init__(self, vocabulary: bytes, pattern: str, encode_special_tokens: bool = True):
        import tiktoken

        file = json.loads(vocabulary)
        model = file["model"]
        # The format writes bytes as printable characters: these stand for themselves, the rest follow from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}
        letters = {byte[t]: i for t, i in model["vocab"].items() if len(t) == 1 and t in byte}
        if len(letters) != 256:
            raise ValueError("the vocabulary lacks single bytes")
        ids = {bytes([b]): i for b, i in letters.items()}
        for merge in model["merges"]:
            token = "".join(merge.split(" ") if isinstance(merge, str) else merge)
            ids[bytes(byte[c] for c in token)] = model["vocab"][token]
        # Ranks must grow with the place in the list of merges; ids need not.
        tokens = list(dict.fromkeys([bytes([b]) for b in sorted(letters, key=letters.get)])) + [t for t in ids if len(t) > 1]
        added = {} if encode_special_tokens else {a["content"]: a for a in file.get("added_tokens", [])}
        if any(a.get(flag) for a in added.values() for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at their surroundings are not supported")
        if any(a != b and b.startswith(a) for a in added for b in added):
            raise ValueError("added tokens that begin with another one are not supported")
        self.encoding = tiktoken.Encoding(
            "own", pat_str=pattern, mergeable_ranks={t: n for n, t in enumerate(tokens)}, special_tokens={t: len(tokens) + n for n, t in enumerate(added)}
        )
        self.ids = np.array([*(ids[t] for t in tokens), *(a["id"] for a in added.values())], np.uint32)

    def encode(self, text: str) -> np.ndarray:
        return self.ids[self.encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=())]


def squeezed(ids: np.ndarray) -> bytes:
    """Unsigned 32-bit ids, compressed: all first bytes, then all second bytes and so on, as the high ones are mostly 0."""
    return pa.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def restored(data: bytes, length: int) -> np.ndarray:
    plain = pa.decompress(data, decompressed_size=4 * length, codec="zstd", asbytes=True)
    return np.frombuffer(plain, np.uint8).reshape(4, length).T.copy().view("<u4").ravel()


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece; only the first may be shorter than the capacity."""
    head = length % capacity or min(length, capacity)
    starts = [0, *range(head, length, capacity)]
    return list(zip(starts, [head, *[capacity] * (len(starts) - 1)], strict=True))


def pieces(
    docs: DataFrame, vocabulary: bytes, pattern: str, key: str = "doc_id", text: str = "text", end: int = 0, capacity: int = CAPACITY,
    keep_ids: bool = True, encode_special_tokens: bool = True, compress: bool = False,
) -> DataFrame:
    """``key, piece, start, length, ids_crc32`` and, if kept, ``ids`` of each piece.

    ``ids`` is an array of numbers or, with ``compress``, what ``squeezed`` makes of it, which
    is a third as long.

    A document is its text's ids and the id ``end``; a null text has ``end`` only. The
    checksum is over little-endian unsigned 32-bit ids. Texts are tokenized whole; for
    ``encode_special_tokens`` see ``Tokenizer``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(docs.dtypes)[key]
    names = ["key", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def table(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        whose, piece, start, length, crc, ids = zip(*rows, strict=True)
        numbers = [pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
        if not keep_ids:
            lists = []
        elif compress:
            lists = [pa.array([squeezed(i) for i in ids], pa.binary())]
        else:
            lists = [pa.array([i.view(np.int32) for i in ids], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(whose)), *numbers, *lists], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(shared.value, pattern, encode_special_tokens)
        for batch in batches:
            rows, held = [], 0
            for n, content in enumerate(batch.column(1)):
                ids = np.append(tokenizer.encode(content.as_py() or ""), np.uint32(end)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows.append((n, piece, start, length, zlib.crc32(part.tobytes()), part))
                held += len(ids)
                if held >= PORTION:
                    yield table(batch.column(0), rows)
                    rows, held = [], 0
            if rows:
                yield table(batch.column(0), rows)

    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if compress else ", ids array<int>") * keep_ids
    return docs.select(F.col(key).alias("key"), text).mapInArrow(work, schema).withColumnRenamed("key", key)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins; every length is 1 to capacity.

    Open bins are stacks by room left, and one bit of a number for each room that occurs.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0
    for n in np.argsort(-lengths, kind="stable"):
        length = int(lengths[n])
        fit = rooms >> length
        if fit:
            room = length + (fit & -fit).bit_length() - 1
            where = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, where = capacity, count
            count += 1
        bins[n], offsets[n] = where, capacity - room
        left = room - length
        if left:
            stacks[left].append(where)
            rooms |= 1 << left
    return bins, offsets, count


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the best of several dual-feasible functions.

    ``counts[x]`` pieces have length x. A dual-feasible function never adds up to more than
    the capacity over lengths that fit into one sequence, so its sum over all pieces,
    divided by the capacity, is a bound.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(counts @ x) // capacity)
    # Lengths above capacity - t fill a sequence, those below t count nothing.
    suffix = np.append(np.cumsum(counts[::-1])[::-1], 0)
    prefix = np.concatenate(([0], np.cumsum(counts * x)))
    t = np.arange(1, capacity // 2 + 1)
    large = suffix[capacity - t + 1] * capacity
    middle = prefix[capacity - t + 1] - prefix[t]
    best = max(best, int(-(-(large + middle).max() // capacity)))
    # Rounding by k steps: what divides evenly stays, the rest is rounded down.
    for k in range(1, 65):
        scaled = x * (k + 1)
        # In units of 1 / k of a sequence, times the capacity where x stays as it is.
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int(counts @ value) // (k * capacity)))
    return best


def _packed(rows: DataFrame, parts: int, turn: int, capacity: int, key: str) -> DataFrame:
    """``rows`` with their partition, bin, offset, the bin's fill, and the partition's bins and bound."""
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(F.col(key), F.col("piece"), F.lit(turn)), F.lit(parts)).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)

    def work(group: pa.Table) -> pa.Table:
        # The order among equal lengths must not depend on the shuffle. Arrow keeps keys as they are, next to nulls too.
        group = group.sort_by([(key, "ascending"), ("piece", "ascending")])
        lengths = group.column("length").to_numpy()
        bins, offsets, count = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=count).astype(np.int64)[bins]
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        figures = {"bin": bins, "offset": offsets, "fill": fill, "bins": np.full(len(bins), count), "bound": np.full(len(bins), bound)}
        for name, values in figures.items():
            group = group.append_column(f"__{name}", pa.array(values, pa.int64()))
        return group

    more = ", ".join(f"__{c} long" for c in ("bin", "offset", "fill", "bins", "bound"))
    # As many shuffle partitions as there are groups, so that tasks stay as large as a group at any size of the table.
    return dealt.repartition(parts, "__part").groupBy("__part").applyInArrow(work, f"{schema}, {more}")


def pack(cut_up: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, per_part: int = PIECES, exchanges: int = EXCHANGES) -> DataFrame:
    """``cut_up`` (a piece a row, with ``piece`` and ``length``) with ``sequence_id`` and ``offset``.

    ``group_sequences`` and ``group_bound`` say how many sequences the pieces that were
    packed together take, and how many they need at least; where both are equal, that
    packing is certified. A piece of full length is a group by itself.

    Offsets are gapless from 0 within a sequence. Pieces of full length are sequences by
    themselves and do not travel. An exchange counts only if it saves sequences. ``length``
    is 1 to ``capacity``; other columns are kept (those called like new ones are
    replaced), so a narrow table travels least. An empty table gives no rows; rows may
    repeat, and equal lengths go by key and piece.
    """
    scratch = Scratch(cut_up.sparkSession)
    cut_up = cut_up.drop("sequence_id", "offset", "group_sequences", "group_bound")
    names = cut_up.columns
    stored = scratch.keep(cut_up, "pieces")
    # Ids above 2 ** 62 are left to full pieces; the numbers hold, as the rows are stored.
    number = F.monotonically_increasing_id() + F.lit(1 << 62)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    full = stored.filter(F.col("length") == capacity)
    done = [full.select(*names, number.alias("sequence_id"), zero.alias("offset"), one.alias("group_sequences"), one.alias("group_bound"))]

    def placed(df: DataFrame, turn: int) -> DataFrame:
        number = F.lit(turn << 56) + F.col("__part") * F.lit(1 << 28) + F.col("__bin")
        figures = F.col("__bins").alias("group_sequences"), F.col("__bound").alias("group_bound")
        return df.select(*names, number.alias("sequence_id"), F.col("__offset").alias("offset"), *figures)

    rest = stored.filter(F.col("length") < capacity)
    current = scratch.keep(_packed(rest, _parts(rest, per_part), 0, capacity, key), "packed-0")
    # Full sequences are as good as those of a certified partition.
    settled = (F.col("__bins") == F.col("__bound")) | (F.col("__fill") == capacity)
    turn = 0
    while turn < exchanges:
        loose = current.filter(~settled)
        if loose.select("__part").distinct().count() < 2:
            break
        turn += 1
        pooled = loose.select(*names)
        again = scratch.keep(_packed(pooled, _parts(pooled, per_part), turn, capacity, key), f"packed-{turn}")
        if _bins(again) >= _bins(loose):
            turn -= 1
            break
        done.append(placed(current.filter(settled), turn - 1))
        current = again
    out = placed(current, turn)
    for more in done:
        out = out.unionByName(more)
    return out


def _parts(rows: DataFrame, per_part: int) -> int:
    return max(1, -(-rows.count() // per_part))


def _bins(rows: DataFrame) -> int:
    return rows.select("__part", "__bin").distinct().count()


def bounds(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Sequences in use and what any packing of all pieces needs, from counts by length."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["length"]] = row["n"]
    return packed.select("sequence_id").distinct().count(), lower_bound(counts, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of pieces that carry their ids; a sequence is bounded by the capacity."""
    if dict(packed.dtypes)["ids"] != "binary":
        rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        return rows.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                found = [np.concatenate([restored(p["ids"], p["length"]) for p in parts]).view(np.int32) for parts in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    return rows.mapInArrow(join, "sequence_id long, ids array<int>")
