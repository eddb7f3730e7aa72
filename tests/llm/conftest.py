import random

import pytest

CLASH = "doc_id long, text string, row string, kept string, state string, source string, lang string, n_chars long"


def make_docs(spark, pairs, source="a"):
    """A table with columns that operators use internally, too."""
    return spark.createDataFrame([(i, x, "r", "k", "s", source, "en", None if x is None else len(x)) for i, x in pairs], CLASH)


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words; seeded."""
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 9))) for _ in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choices(words, k=n))
