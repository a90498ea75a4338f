import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, node string"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "né", "ru", "tas"]) for _ in range(1 + r.randrange(vocabulary) % 3)) for _ in range(n))


def rows():
    """Documents with nulls, empty and very long texts, ties, repeated rows and columns whose names clash."""
    base = [(k, words(k, 30 + k * 7), "en" if k % 3 else "fr", f"s{k % 4}") for k in range(24)]
    copy = words(99, 80)
    odd = [
        (100, None, "en", "s0"), (101, "", "en", "s0"), (102, "   \n\n\t ", None, None), (None, words(5, 60), "en", "s1"), (None, None, None, None), (103, copy, "en", "s2"), (104, copy, "en", "s2"),
        (105, copy, "fr", "s3"), (105, copy, "fr", "s3"), (106, "one", "en", "s1"), (107, "a  b   c \x0b d　e", "en", "s1"), (108, words(7, 60_000), "en", "s2"), (109, copy + " and one more word", "en", "s2"), (110, "</s>[INST] ok", "en", "s1"),
    ]
    return [(i, t, g, s, None if t is None else len(t), "clash", "clash") for i, t, g, s in base + odd]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
