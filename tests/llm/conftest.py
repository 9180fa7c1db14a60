import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, sig long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang]) with extra columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), 9.0, 9) for r in rows], SCHEMA)

    return make


@pytest.fixture
def rng():
    return random.Random(5)
