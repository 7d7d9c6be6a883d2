"""Byte-level BPE by recursive queries in each partition.

Spark deals out the texts; inside a task, an in-process DuckDB holds the merge table and
contracts the partition's distinct words round by round in a recursive query. Decoding
joins token ids with the vocabulary and puts the bytes together by an ordered aggregation.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Characters of text that are split and encoded at a time.
PORTION = 1_000_000
# Distinct words that a task remembers before it starts anew.
REMEMBERED = 400_000
# Letters that one recursive query starts with, and the states of letters it may hold. A query
# ends after at most ROUNDS rounds; unfinished words go on in the next.
LETTERS, HELD, ROUNDS = 250_000, 4_000_000, 64

# A round opens each word to one row for every token and its place, joins these rows with the
# merge table, and contracts the leftmost pair of least rank. A word without pairs is done.
LEFTMOST = """
WITH RECURSIVE state(turn, word, toks, done) AS (
    SELECT 0, word, toks, false FROM words
    UNION ALL
    (WITH places AS (
        SELECT word, unnest(toks[:-2]) AS tok, unnest(toks[2:]) AS after, generate_subscripts(toks[2:], 1) AS pos
        FROM state WHERE NOT done),
    best AS (
        SELECT word, min(m.merged * 1000::BIGINT + pos) AS spot
        FROM places p JOIN merges m ON m.first = p.tok AND m.second = p.after GROUP BY word)
    SELECT turn + 1, s.word,
           CASE WHEN spot IS NULL THEN toks ELSE toks[:spot % 1000 - 1] || [(spot // 1000)::INT] || toks[spot % 1000 + 2:] END,
           spot IS NULL
    FROM state s LEFT JOIN best USING (word) WHERE NOT s.done))
SELECT word, toks FROM state WHERE done ORDER BY word
"""

# Words of more than SHORT letters stay rows, and a round also contracts that pair's further
# places that do not overlap. Those cannot be spoilt: in a vocabulary whose tokens
# encode to themselves, a contraction of rank r never makes a pair of rank below r.
SHORT = 64
ALL_PLACES = """
WITH RECURSIVE state(turn, word, pos, tok, done) AS (
    SELECT 0, word, pos, tok, false FROM letters
    UNION ALL
    (WITH pairs AS (
        SELECT turn, word, pos, tok, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS after
        FROM state WHERE NOT done AND turn < $rounds),
    ranked AS (
        SELECT p.turn, p.word, p.pos, p.tok, m.merged FROM pairs p
        LEFT JOIN merges m ON m.first = p.tok AND m.second = p.after),
    least AS (
        SELECT *, min(merged) OVER (PARTITION BY word) AS best,
               row_number() OVER (PARTITION BY word ORDER BY pos) AS n FROM ranked),
    runs AS (
        SELECT *, n - max(CASE WHEN merged = best THEN 0 ELSE n END)
                      OVER (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING) AS place FROM least),
    chosen AS (
        SELECT *, lag(place % 2 = 1, 1, false) OVER (PARTITION BY word ORDER BY pos) AS swallowed FROM runs)
    SELECT turn + 1, word, pos, CASE WHEN place % 2 = 1 THEN merged ELSE tok END, best IS NULL
    FROM chosen WHERE NOT swallowed))
SELECT word, pos, tok, done FROM state WHERE done OR turn = $rounds ORDER BY word, pos
"""

DECODE = """
SELECT doc, string_agg(bytes, '' ORDER BY pos) AS bytes
FROM tokens LEFT JOIN vocabulary USING (tok) GROUP BY doc ORDER BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """``first, second, merged``: all ways to split a token in two."""
    rows = [
        (first, second, merged)
        for token, merged in ranks.items()
        for cut in range(1, len(token))
        if (first := ranks.get(token[:cut])) is not None and (second := ranks.get(token[cut:])) is not None
    ]
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(c, pa.int32()) for c in columns], ["first", "second", "merged"])


def _database():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})


def _load(con, name: str, rows: pa.Table) -> None:
    con.register("loading", rows)
    con.execute(f"CREATE TABLE {name} AS SELECT * FROM loading")
    con.unregister("loading")


class Encoder:
    """Encodes texts; remembers the words it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.letters = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = _database()
        _load(self.con, "merges", merge_table(ranks))
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.lengths, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def contract(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each of a few words of two to SHORT bytes."""
        ends = np.cumsum([0, *map(len, words)])
        tok = self.letters[np.frombuffer(b"".join(words), np.uint8)]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tok))
        self.con.register("words", pa.table({"word": pa.array(range(len(words)), pa.int32()), "toks": lists}))
        found = self.con.sql(LEFTMOST).to_arrow_table()["toks"].combine_chunks()
        self.con.unregister("words")
        return np.split(found.flatten().to_numpy(), found.offsets.to_numpy()[1:-1] - found.offsets[0].as_py())

    def contract_long(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each of a few words of any length from two bytes on."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        tok = self.letters[np.frombuffer(b"".join(words), np.uint8)]
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        while len(word):
            self.con.register("letters", pa.table({"word": word, "pos": pos, "tok": tok}))
            rounds = min(ROUNDS, max(1, HELD // len(word)))
            found = self.con.execute(ALL_PLACES, {"rounds": rounds}).fetchnumpy()
            self.con.unregister("letters")
            word, pos, tok, done = (np.asarray(found[c]) for c in ("word", "pos", "tok", "done"))
            ready = done.astype(bool)
            heads = np.flatnonzero(np.diff(word[ready], prepend=-1))
            for w, ids in zip(word[ready][heads], np.split(tok[ready], heads[1:]), strict=True) if len(heads) else ():
                out[w] = ids
            word, pos, tok = word[~ready], pos[~ready], tok[~ready]
        return out

    def learn(self, words: list[str]) -> None:
        """Encode words that are new; a word that is a token as a whole is that token."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = [self.ranks.get(r) for r in raw]
        ids = [None if t is None else np.array([t], np.int32) for t in whole]
        for contract, short in ((self.contract, True), (self.contract_long, False)):
            split = [n for n, t in enumerate(whole) if t is None and (len(raw[n]) <= SHORT) == short]
            for start, end in _portions((len(raw[n]) for n in split), LETTERS):
                for n, found in zip(split[start:end], contract([raw[n] for n in split[start:end]]), strict=True):
                    ids[n] = found
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.ids = np.concatenate([self.ids, *ids])

    def encode(self, texts: list[str]) -> pa.Array:
        """A list of ids for each text."""
        if len(self.index) > REMEMBERED:
            self.forget()
        index, new, words, ends = self.index, [], [], [0]
        for text in texts:
            for w in self.split(text):
                at = index.get(w)
                if at is None:
                    at = index[w] = len(index)
                    new.append(w)
                words.append(at)
            ends.append(len(words))
        if new:
            self.learn(new)
        words = np.array(words, np.int64)
        lengths = self.lengths[words]
        total = np.concatenate(([0], np.cumsum(lengths)))
        at = np.arange(total[-1]) - np.repeat(total[:-1] - self.starts[words], lengths)
        return pa.ListArray.from_arrays(pa.array(total[ends], pa.int32()), pa.array(self.ids[at], pa.int32()))


def _portions(sizes: Iterator[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most``."""
    start, held, n = 0, 0, 0
    for n, size in enumerate(sizes, 1):
        held += size
        if held >= most:
            yield start, n
            start, held = n, 0
    if start < n:
        yield start, n


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``ids`` (array of int) of each row; a null text has no ids.

    Each match of ``pattern`` is encoded by itself and without special tokens. Texts are
    encoded whole, however long; every row comes back, repeated ones too. The vocabulary
    must hold all 256 single bytes. It goes from the driver to the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = dict(docs.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            texts = batch.column(1)
            for start, end in _portions((len(t.as_py() or "") for t in texts), PORTION):
                part = batch.slice(start, end - start)
                ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["key", "ids"])

    return docs.select(F.col(key).alias("key"), text).mapInArrow(work, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(rows: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with ``ids`` replaced by ``out``, the bytes that they stand for.

    Null and empty lists decode to no bytes; an id outside the vocabulary is an error.
    """
    shared = rows.sparkSession.sparkContext.broadcast(ranks)
    others = [c for c in rows.columns if c not in (ids, out)]
    kinds = dict(rows.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _database()
        known = shared.value
        _load(con, "vocabulary", pa.table({"tok": pa.array(known.values(), pa.int32()), "bytes": [t.hex() for t in known]}))
        for batch in batches:
            column = batch.column(len(others))
            for start, end in _portions((len(v) if v.is_valid else 0 for v in column), PORTION):
                part = column.slice(start, end - start)
                lengths = np.array([len(v) if v.is_valid else 0 for v in part], np.int64)
                tok = part.flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(lengths)), lengths)
                pos = np.arange(len(tok)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                if len(tok) and not np.isin(tok, np.fromiter(known.values(), np.int64, len(known))).all():
                    raise ValueError("an id is not in the vocabulary")
                con.register("tokens", pa.table({"doc": doc, "pos": pos, "tok": tok}))
                decoded = dict(con.execute(DECODE).fetchall())
                con.unregister("tokens")
                values = pa.array([bytes.fromhex(decoded.get(n, "")) for n in range(len(lengths))], pa.binary())
                kept = [batch.column(n).slice(start, end - start) for n in range(len(others))]
                yield pa.RecordBatch.from_arrays([*kept, values], [*others, out])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), f"`{out}` binary"])
    return rows.select(*others, ids).mapInArrow(work, schema)
