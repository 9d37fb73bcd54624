import random

import pytest

PARTS = "er on the in ti an re ed es or ly th st nd ha ou".split()


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choices(PARTS, k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


@pytest.fixture(scope="session")
def make():
    return prose


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Null, empty and blank texts, copies, near copies, ties, repeated rows, long texts and a null id."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(3, 400)) for _ in range(60)]
    texts = [*base, *base[:20], base[0], base[0], None, "", "", "  \n ", "...", "A a a", prose(rng, 30_000)]
    texts += [base[3] + " ", "prefix " + base[4], base[5].upper(), base[6] + "\nmore", base[7][:-1]]
    rows = [(i, t, rng.choice(["en", "de", None]), "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (2, "another text under a used id", "en", "s", 1), (None, base[1], "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
