import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra array<string>"


@pytest.fixture
def table(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) tuples, with the usual and one more column."""

    def make(rows):
        full = [(d, t, lang[0] if lang else None, "s", len(t or ""), ["x"]) for d, t, *lang in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


@pytest.fixture
def odd_rows():
    """Null, empty and blank texts, long ones, other scripts, repeated rows and a null id."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 30_000), (5, "日本語 テキスト😀"), (6, "twice here now"), (6, "twice here now"), (None, "no id at all"), (7, "\x00﻿ x"), (8, "a" * 50_000), (9, "Twice HERE now")]


@pytest.fixture
def prose():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    return lambda n, seed: (lambda r: [r.choice(vocabulary) for _ in range(n)])(random.Random(seed))
