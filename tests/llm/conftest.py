import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, rank double, comp long"


@pytest.fixture
def docs_of(spark):
    """Documents of (doc_id, text[, lang, source]) with extra columns whose names operators use inside."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1]), "k", -1, 0.5, 7) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def words():
    import random

    def make(n, seed=0):
        g = random.Random(seed)
        return ["".join(g.choice("abcdefghijklmnop") for _ in range(g.randint(2, 8))) for _ in range(n)]

    return make
