import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with everything that may be missing, empty, long, equal or repeated."""
    rng = random.Random(11)
    base, passage, long = prose(rng, 150), prose(rng, 70), prose(rng, 30_000)
    rows = [
        (1, base, "en", "s", 1), (2, base, "en", "s", 1), (3, base.replace(" a", " b", 1), "en", None, None), (3, "a second text of document three", None, "s", 1),
        (4, None, None, None, None), (5, "", "en", "s", 0), (6, " \n\t ", "en", "s", 0), (7, "one", "fr", "s", 3), (7, "one", "fr", "s", 3), (None, base, "en", "s", 1), (None, None, None, None, None),
        (8, prose(rng, 40) + "\n" + passage + " x " + prose(rng, 40), "de", "s", 1), (9, prose(rng, 33) + " " + passage + "\n" + prose(rng, 51), "de", "s", 1), (10, long, "es", "s", 1), (11, "12 34 !?", "en", "s", 1),
        (12, "ONE", "en", "s", 3), (13, "aaaa " * 400, "en", "s", 1), (14, "😀 日本語 ñ </s>[INST]", "es", "s", 1), (15, long[:150_000], "es", "s", 1), (-5, base, "en", "s", 1),
    ]
    return rows


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
