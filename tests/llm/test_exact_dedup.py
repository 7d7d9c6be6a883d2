import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from llm_docs import docs_of  # noqa: F401
from separatrix.llm import exact_dedup

random.seed(2)
LONG = " ".join(random.choices("the chapel had ten tickets and pictures of a plain bell in every garden hall by night".split(), k=5000))
ROWS = [(5, "a"), (9, "a"), (7, "A"), (1, None), (2, ""), (3, LONG), (4, LONG), (6, LONG + "!"), (8, "x" * 20_000), (8, "x" * 20_000), (10, "x" * 20_001)]


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_groups_of_equal_texts(docs_of):
    got = sorted(map(tuple, exact_dedup.deduplicate(docs_of(ROWS)).collect()))
    assert got == expected(ROWS)


def test_identifiers_that_several_contents_share(docs_of):
    # All chunks of one length get one identifier; only contents tell them apart.
    rows = [(1, "a" * 10 + "b" * 10), (2, "b" * 10 + "a" * 10), (3, "a" * 10 + "b" * 10), (4, "c" * 20), (5, None)]
    weak = exact_dedup.deduplicate(docs_of(rows), identifier=lambda c: F.length(c).cast("long"), shortest=2, longest=10)
    assert sorted(map(tuple, weak.collect())) == expected(rows)


def test_chunks_are_the_text_and_follow_content(docs_of):
    rows = docs_of([(1, LONG), (2, "prefix " + LONG), (3, ""), (4, "z" * 9000)]).select("doc_id", exact_dedup.chunks(F.col("text")).alias("c"))
    found = {r["doc_id"]: r["c"] for r in rows.collect()}
    assert "".join(found[1]) == LONG and "".join(found[2]) == "prefix " + LONG and found[3] == []
    assert [len(c) for c in found[4]] == [4096, 4096, 808]
    assert all(256 <= len(c) <= 4096 for c in found[1][:-1]) and set(found[1]) & set(found[2])


def test_missing_keys_and_no_rows(docs_of):
    got = {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.deduplicate(docs_of([(None, "a"), (3, "a"), (None, "b")])).collect()}
    assert got == {(None, 3, False), (3, 3, True), (None, None, True)}
    assert exact_dedup.deduplicate(docs_of([])).count() == 0


def test_shared_identifiers_without_keys(docs_of):
    # Two texts without keys and under one key, told apart by contents only.
    one, two = "a" * 10 + "b" * 10, "b" * 10 + "a" * 10
    rows = [(None, one), (None, two), (7, one), (7, two), (3, two)]
    weak = exact_dedup.deduplicate(docs_of(rows), identifier=lambda c: F.length(c).cast("long"), shortest=2, longest=10)
    got = sorted((repr(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in weak.collect())
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in (one, two)}
    want = [("None", 7, 2, False, digest[one]), ("7", 7, 2, True, digest[one])] + [(k, 7, 3, k == "7", digest[two]) for k in ("None", "7", "3")]
    assert got == sorted(want)


def test_chunks_follow_content_in_any_script(docs_of):
    rng = random.Random(3)
    alphabets = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": "0123456789", "cyrillic": "".join(map(chr, range(0x430, 0x450))),
                 "chinese": "".join(map(chr, range(0x4E00, 0x9000, 7))), "greek": "".join(map(chr, range(0x3B1, 0x3CA))), "korean": "".join(map(chr, range(0xAC00, 0xD700, 11))),
                 "arabic": "".join(map(chr, range(0x621, 0x64B))), "hindi": "".join(map(chr, range(0x905, 0x93A)))}
    rows = []
    for n, letters in enumerate(alphabets.values()):
        text = " ".join("".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(6000))
        rows += [(2 * n, text), (2 * n + 1, text[:3] + "12345" + text[3:])]
    found = {r["doc_id"]: r["c"] for r in docs_of(rows).select("doc_id", exact_dedup.chunks(F.col("text")).alias("c")).collect()}
    for n, name in enumerate(alphabets):
        plain, shifted = found[2 * n], found[2 * n + 1]
        assert "".join(plain) == rows[2 * n][1] and "".join(shifted) == rows[2 * n + 1][1]
        # All but a few chunks at the start are found again.
        assert len(plain) > 15 and len(set(plain) & set(shifted)) > 0.8 * len(plain), name
