from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture()
def docs(spark):
    """Make a documents table of (doc_id, text) or of whole rows."""

    def make(rows, extra=""):
        full = [r if len(r) > 2 else (r[0], r[1], "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS + extra)

    return make
