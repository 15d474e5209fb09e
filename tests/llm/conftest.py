import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, kept string"


@pytest.fixture()
def make_docs(spark):
    """Documents with extra columns whose names clash with the operators' own."""
    def make(texts, ids=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        langs = langs or ["en"] * len(texts)
        return spark.createDataFrame([(i, t, la, "s", len(t or ""), 1.0, "x", "y") for i, t, la in zip(ids, texts, langs)], DOC_SCHEMA)
    return make


@pytest.fixture()
def words():
    import random
    rng = random.Random(5)
    pool = ["".join(rng.choice("abdefgilmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(3000)]

    def make(n, seed):
        own = random.Random(seed)
        return " ".join(own.choice(pool) for _ in range(n))
    return make
