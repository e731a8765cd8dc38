import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def invented(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ta", "ri", "no", "shu", "be", "lo"]) for _ in range(r.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, copies, near copies, repeated rows and ids."""
    long = invented(1, 20_000)
    near = invented(2, 400)
    rows = [
        (1, invented(3, 50), "en", "a", 1),
        (2, invented(3, 50), "en", "a", 1),
        (2, invented(3, 50), "en", "a", 1),
        (3, near, "fr", "b", None),
        (4, near + " more words", "fr", None, 2),
        (5, "", "en", "a", 0),
        (6, " \n\t ", None, "a", 3),
        (7, None, "en", "c", None),
        (None, invented(3, 50), "en", "a", 1),
        (None, None, None, None, None),
        (8, long, "fr", "b", 9),
        (9, long, "fr", "b", 9),
        (10, "one two", "en", "é", 7),
        (11, "One  TWO", "en", "é", 7),
        (12, "12 34 -- 56", "en", "a", 7),
        (13, "日本語 " * 30 + "😀 \x00 ▁ x", "en", "a", 7),
        (14, "w" * 3000, "en", "a", 7),
        (2, "the same id, another text", "en", "b", 1),
    ]
    return spark.createDataFrame(rows, DOC)
