import random

import pytest

@pytest.fixture()
def rng():
    return random.Random(20)


@pytest.fixture()
def documents(spark):
    """Documents with nulls, empties, ties, repeated rows, long texts and columns whose names clash."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long, size int, score string, found string, z int, target string"):
        full = [(*r, *[None] * (10 - len(r))) for r in rows]
        return spark.createDataFrame(full, schema)

    return make
