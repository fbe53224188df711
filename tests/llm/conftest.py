import random

import pytest

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def pairs(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, hostile bytes."""
    rng = random.Random(3)
    prose = " ".join(rng.choice("alpha beta gamma delta of the and".split()) for _ in range(400))
    unique = " ".join(f"w{i}" for i in range(120))
    return [
        (1, None, "en", "a", 0),
        (2, "", None, "a", 0),
        (3, " \n\t\x0b ", "en", None, 4),
        (4, "one", "en", "b", 3),
        (5, prose, "en", "b", None),
        (6, prose, "en", "c", len(prose)),
        (6, prose, "en", "c", len(prose)),
        (7, unique, "de", "c", 1),
        (8, unique.replace("w60", "other"), "de", "d", 1),
        (9, "the " * 3000, "en", "d", 1),
        (10, "x" * 5000, "en", "d", 1),
        (11, "1 " * 4000 + "+1 " + "9" * 4000, "en", "e", 1),
        (12, "naïve \U0001f600 ünïcode space 中文", "fr", "e", 1),
        (13, "a" * 20 + "@" * 50 + "b.c" * 40, "fr", "e", 1),
        (14, unique + "\n" + unique, "fr", "e", 1),
        (None, "no id " + unique, None, None, None),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, ODD)
