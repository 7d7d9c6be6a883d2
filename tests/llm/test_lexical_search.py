import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from llm_docs import docs_of  # noqa: F401
from separatrix.llm import lexical_search
from separatrix.llm.lexical_search import Settings, Shard, ShardSearch
from separatrix.storage import materialize

# Small shards, blocks and windows, so that few documents fill many of them.
SMALL = Settings(portion=400, block=4, window=16)


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", lower)


def ranked(rows, text, k):
    """Scores of all documents, one by one."""
    counts = [(key, Counter(words(t))) for key, t in rows]
    counts = [(key, c) for key, c in counts if c]
    size, total = len(counts), sum(c.total() for _, c in counts)
    scores = []
    for key, c in counts:
        m, score = 75 + 25 * c.total() * size // total, 0
        for term in words(text):
            if c[term]:
                df = sum(term in other for _, other in counts)
                score += math.floor(1000 * math.log((2 * size + 2) / (2 * df + 1))) * (10**9 * c[term] // (1000 * c[term] + 12 * m))
        if score > 0:
            scores.append((-score, key is None, key))
    return [(rank, key, -score) for rank, (score, _, key) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]


def some_rows(n, seed=4):
    rng = random.Random(seed)
    known = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i * 3, " ".join(rng.choices(known, weights, k=rng.choice([1, 5, 20, 80])))) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings", [SMALL, Settings(portion=400, block=4, window=16, query_terms=3)])
def test_every_document(spark, docs_of, settings):
    rows = some_rows(300) + [(901, None), (902, ""), (903, ". , !"), (None, "w1 w2"), (904, "W1 w2"), (904, "w1 w2")]
    index = materialize(lexical_search.build(docs_of(rows).repartition(3), settings=settings), "index")
    assert index.filter("term is null").count() > 5
    items = [(1, "w0 w1 w1 w40"), (2, "w59, W3; w17!"), (3, "unknown"), (4, None), (5, "w0"), (6, "w1 w2"), (6, "w30 w31 w32 w33 w0 w1 w2"), (None, "w50")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    found = {}
    for r in lexical_search.search(index, frame, k=7, settings=settings).collect():
        found.setdefault((r["item"], r["query"]), []).append((r["rank"], r["key"], r["score"]))
    want = [(item, ranked(rows, text, 7)) for item, text in items]
    got = [(item, sorted(results)) for (item, _), results in found.items()]
    order = lambda x: (x[0] or 0, [(r, s) for r, _, s in x[1]])
    assert sorted(got, key=order) == sorted([w for w in want if w[1]], key=order)


def test_empty_tables(spark, docs_of):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    nothing = materialize(lexical_search.build(docs_of([])), "index")
    assert nothing.count() == 0 and lexical_search.search(nothing, items).count() == 0
    index = materialize(lexical_search.build(docs_of([(1, "a")])), "index")
    assert lexical_search.search(index, items.filter("false")).count() == 0
    assert lexical_search.search(index, items).count() == 1


def shard_of(rows, settings):
    shard = Shard(settings)
    for key, text in rows:
        shard.add(key, lexical_search.terms(text))
    table = pa.Table.from_batches(list(shard.rows(7, pa.int64())))
    is_block = pa.compute.is_valid(table.column("term"))
    return table.filter(pa.compute.invert(is_block)), table.filter(is_block)


def test_blocks_are_rejected_before_they_are_unpacked():
    # One rare term decides; the common one is in nearly all documents.
    rng = random.Random(2)
    rows = [(i, "common " * rng.randrange(1, 4) + ("rare " * 3 if i % 97 == 0 else "") + "x " * rng.randrange(30)) for i in range(4000)]
    settings = Settings(block=16, window=256)
    documents, blocks = shard_of(rows, settings)
    total = sum(len(t.split()) for _, t in rows)
    search = ShardSearch(documents, blocks, (len(rows), total), settings)
    found, scores = search.best([("rare", 4000), ("common", 30)], 5)
    weight = lambda c, term, w: w * (10**9 * c[term] // (1000 * c[term] + 12 * (75 + 25 * c.total() * len(rows) // total))) if c[term] else 0
    every = sorted(((-weight(c, "rare", 4000) - weight(c, "common", 30), key) for key, c in ((key, Counter(t.split())) for key, t in rows)))
    assert [(-int(s), int(search.keys[int(d)].as_py())) for d, s in zip(found, scores, strict=True)] == every[:5]
    assert len(search.unpacked) < blocks.num_rows / 4


def test_peaks_are_the_largest_contributions():
    settings = Settings(block=8)
    rows = some_rows(200, seed=9)
    documents, blocks = shard_of(rows, settings)
    # Another table's statistics than those of this shard alone.
    search = ShardSearch(documents, blocks, (5000, 77_777), settings)
    for block in range(blocks.num_rows):
        docs, values = search.unpack(block)
        assert search.peak[block] == values.max() and docs[0] == search.first[block] and docs[-1] == search.last[block]
        assert (np.diff(docs) > 0).all()


def test_wide_numbers():
    # Counts and gaps that need more than one byte.
    rows = [(i, "a " * 70_000 if i in (0, 1) else "a " * 300 if i == 2 else "b") for i in range(1500)] + [(9999, "a")]
    documents, blocks = shard_of(rows, Settings())
    search = ShardSearch(documents, blocks, (1501, 1_000_000), Settings())
    docs, values = search.unpack(search.lists["a"].start)
    n = np.array([70_000, 70_000, 300, 1])
    assert docs.tolist() == [0, 1, 2, 1500] and values.tolist() == lexical_search.contribution(n, n, 1501, 1_000_000, Settings()).tolist()
