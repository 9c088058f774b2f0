"""Awkward documents that every operator has to take."""

import random

import pytest

LONG = " ".join(random.Random(3).choice(["alpha", "beta", "gamma", "delta", "épsilon", "zeta,", "Eta."]) for _ in range(60_000))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, node string, row string, shard string, words string, start string, total string, score string"


def rows(texts):
    return [(i, t, lang, src, None if t is None else len(t), -1, "fp", "node", "row", "shard", "words", "start", "total", "score") for i, t, lang, src in texts]


AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away again", "en", "a"), (2, None, "en", None), (3, "", None, "b"), (4, " \t\n ", "fr", "b"), (5, LONG, None, "c"), (6, "The quick brown fox jumps over the lazy dog and runs away again", "en", "a"),
    (6, "The quick brown fox jumps over the lazy dog and runs away again", "en", "a"), (7, "<|endoftext|> x <|startoftext|>", "en", None), (8, "中文 текст 🙂 é İ \x1c\x85 zero\x00", None, "c"), (None, "no id here at all", "en", "d"), (9, "1234 5678", "de", "d"), (-5, "word", "de", "d"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(rows(AWKWARD), COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
