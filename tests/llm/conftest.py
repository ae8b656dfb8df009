import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents-like rows from texts, with the table's other columns and clashing names."""

    def make(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", "src", len(t or ""), 1, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, score string").repartition(3)

    return make


@pytest.fixture(scope="session")
def words():
    import random

    rng = random.Random(17)
    known = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    return lambda n, seed: " ".join(random.Random(seed).choices(known, k=n))
