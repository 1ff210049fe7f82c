import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, schema=DOC):
        full = [(*r, *[None] * (5 - len(r))) if schema == DOC else r for r in rows]
        return spark.createDataFrame(full, schema)

    return make


def sentence(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
