import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, name string, score double, kept boolean, h string, pos int, size string, target int, rank int"


@pytest.fixture
def make_docs(spark):
    """Documents with extra columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, lang, src, None, "x", 0.5, None, "h", 1, "s", 2, 3) for i, t, lang, src in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def odd_rows():
    """Nulls in every column, blanks, ties, repeated rows and a very long text."""
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "delta", "épée", "zeta", "eta", "theta"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = text(60_000)
    base = text(40)
    return [
        (1, base, "en", "a"), (2, base.replace(" ", "\n"), "en", "b"), (3, base + " ", None, "a"), (3, base + " ", None, "a"),
        (4, None, "en", "a"), (5, "", "fr", None), (6, " \t\n\x0b\x0c\r ", "fr", "b"), (7, "x", None, "c"), (8, "!!! ...", "en", "c"),
        (None, text(30), "fr", "a"), (None, None, None, None), (9, long, "en", "d"), (10, long + " more", "en", "a"), (11, text(3), "fr", "b"),
        (12, base, "en", "c"), (13, "a\x00b   c\x1cd", "en", "a"),
    ]
