import random
import string

from pyspark.sql import functions as F

from separatrix.functions import text as tx

NASTY = "ab Z09é漢!'#\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0      　 .-"


def strings(n=300):
    rng = random.Random(4)
    return ["".join(rng.choice(NASTY) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_tokens_and_punctuation_equal_python(spark):
    texts = strings()
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = df.select(
        "id", tx.tokens("text").alias("t"), tx.remove_punctuation("text").alias("c")
    ).collect()
    table = str.maketrans("", "", string.punctuation)
    for r in rows:
        assert r["t"] == texts[r["id"]].split()
        assert r["c"] == texts[r["id"]].translate(table)


def test_counts_and_maps(spark):
    texts = [(1, "a b a"), (2, ""), (3, None), (4, "B b")]
    df = spark.createDataFrame(texts, "id long, text string")
    counts = {(r["id"], r["word"]): r["n"] for r in tx.word_counts(df, "id", "text").collect()}
    assert counts == {(1, "a"): 2, (1, "b"): 1, (4, "b"): 2}
    maps = tx.word_count_map(df, "id", "text")
    assert {r["id"]: r["word_count"] for r in maps.collect()} == {1: {"a": 2, "b": 1}, 2: {}, 3: {}, 4: {"b": 2}}
    trimmed = maps.filter("id = 1").select(
        tx.trim_map("word_count", ["a", "z"]).alias("kept"),
        tx.trim_map("word_count", ["a", "z"], exclude=True).alias("left"),
    ).first()
    assert trimmed["kept"] == {"a": 2} and trimmed["left"] == {"b": 1}


def test_given_words_are_exact_and_case_sensitive(spark):
    texts = [(1, "the The the them"), (2, None), (3, "great")]
    df = spark.createDataFrame(texts, "id long, text string")
    rows = tx.with_word_vector(df, "text", ["the", "The", "great"]).orderBy("id").collect()
    assert [r["features"].toArray().tolist() for r in rows] == [[2, 1, 0], [0, 0, 0], [0, 0, 1]]
    flags = df.select(tx.has_word("text", "the").alias("f")).collect()
    assert [r["f"] for r in flags] == [1, 0, 0]


def test_vocabulary_order(spark):
    df = spark.createDataFrame([("b a a",), ("b c",), ("c a",)], "text string")
    assert tx.vocabulary(df, "text", 2) == ["a", "b"]
    assert {tuple(r) for r in tx.document_frequency(df, "text").collect()} == {("a", 2), ("b", 2), ("c", 2)}


def test_long_texts_are_counted_whole(spark):
    df = spark.range(1).select("id", F.repeat(F.lit("x y "), 50000).alias("text"))
    assert {r["word"]: r["n"] for r in tx.word_counts(df, "id", "text").collect()} == {"x": 50000, "y": 50000}
