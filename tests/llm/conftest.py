"""Small tables that every operator must get through: nulls, empty and very long texts, ties, repeated rows, and
columns whose names clash with those that operators use inside."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, c string, v long, score double, rank int"


def _text(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice("abcdefghijklmnop") + rng.choice(["a", "ul", "in", "ost", "e"]) for _ in range(words))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(4)
    base = _text(rng, 120)
    near = base.split()
    near[60] = "changed"
    shared = _text(rng, 30)
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "One"), (6, "one two three"), (7, "one two  three"),
        (8, base), (9, base.upper()), (10, " ".join(near)), (11, base), (11, base), (12, _text(rng, 20) + " " + shared),
        (13, shared + "\n" + _text(rng, 25)), (14, _text(rng, 9000)), (None, base), (None, None),
        (15, "a b a b a b a b a b a b a b a b a b a b a b a b a b a b a b"),
        (16, "x a b a b a b a b a b a b a b a b a b y"), (17, "été ÉTÉ \U0001f600   nbsp"),
        (18, "trailing  "), (19, " lead\n \n x  y \n"),
    ]
    for i in range(20, 60):
        words = base.split()
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = _text(rng, 1)
        rows.append((i, " ".join(words)))
    for i in range(60, 80):
        rows.append((i, _text(rng, rng.choice([3, 12, 13, 14, 40, 200])) + (" " + shared if i % 3 == 0 else "")))
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "c", 1, 0.5, 1) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
