import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source]) rows, with extra columns whose names clash with inner ones."""
    def make(rows, schema=DOCS):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        df = spark.createDataFrame(full, schema)
        return df.selectExpr("*", "'x' as `rank`", "1 as `size`", "2 as row", "'k' as key", "3 as `a.b`")
    return make


@pytest.fixture
def prose():
    def make(n, seed):
        rnd = random.Random(seed)
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(n))
    return make
