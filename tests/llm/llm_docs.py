import pytest

# Columns of the operators' own tables, to clash with.
EXTRA = "key string, class string, bucket string, part int, score string, found string, n int, home string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) rows, with columns whose names the operators use, too."""

    def make(rows):
        more = ("k", "c", None, 1, "s", "f", 2, "h")
        return spark.createDataFrame([(i, t, *more) for i, t in rows], f"doc_id long, text string, {EXTRA}")

    return make
