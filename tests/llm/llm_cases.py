"""Helpers and fixtures of the tests in this folder."""

import random

import pytest

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(words))


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or from (doc_id, text) pairs."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs, empty, blank, short, very long and repeated texts, a repeated key, no key."""
    rng = random.Random(4)
    text = prose(rng, 60)
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "a"),
        (5, text),
        (5, text),
        (6, text),
        (7, prose(rng, 30_000)),
        (8, "x" * 50_000),
        (None, text),
        (None, None),
        (9, "\n".join([text] * 3)),
        (9, "another text under the same key, " + prose(rng, 40)),
    ]
