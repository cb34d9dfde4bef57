import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, uid string, h string, band string, root string, shard string, _id string, _key string, _source string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """(doc_id, text[, source]) rows → documents with clashing extra columns."""

    def make(rows):
        full = [(i, t, "en", s[0] if s else "a", len(t) if t is not None else None, *["x"] * 10) for i, t, *s in rows]
        return spark.createDataFrame(full, DOC_SCHEMA)

    return make


@pytest.fixture(scope="session")
def words():
    def make(n, seed=0, vocabulary=5_000):
        import random
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))
    return make
