from __future__ import annotations

import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Build a small documents table from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def build(*rows, extra: str = ""):
        filled = [(*row, *[None] * (5 - len(row))) for row in rows]
        made = spark.createDataFrame(filled, DOCUMENTS)
        for name in extra.split():  # names that an operator may use itself
            made = made.selectExpr("*", f"'x' AS `{name}`")
        return made

    return build


@pytest.fixture
def rng():
    return random.Random(7)


def prose(rng, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))
