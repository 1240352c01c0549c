import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece string, label string"


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and extra columns whose names clash."""
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta,", "epsilon.", "the", "of", "and", "é", "naïve", "中文", "x1", "don't", "###", "..."]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(1, 120))), "en", "s", 1, "p", "l") for k in range(40)]
    rows += [(40, rows[3][1], "en", "s", 1, "p", "l"), (41, rows[3][1] + " end", None, None, None, None, None), (42, None, None, None, None, None, None), (43, "", "", "", 0, "", "")]
    rows += [(44, " \n\t ", "en", "s", 1, "p", "l"), (None, "no id here", "en", "s", 1, "p", "l"), (45, " ".join(rng.choices(words, k=30_000)), "en", "s", 1, "p", "l"), (46, "a" * 20_000, "en", "s", 1, "p", "l")]
    rows += [(47, "same row", "en", "s", 1, "p", "l")] * 2 + [(48, "<|endoftext|> a <|endoftext|>", "en", "s", 1, "p", "l")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
