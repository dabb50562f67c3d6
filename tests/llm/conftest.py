from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from texts, or from (doc_id, text, lang, source)."""

    def make(*rows, extra=""):
        full = []
        for i, r in enumerate(rows):
            r = (i, r, "en", "a") if isinstance(r, str) or r is None else r
            full.append((*r[:4], len(r[1] or ""), *r[4:]))
        return spark.createDataFrame(full, DOCS + extra)

    return make


def words(n, seed, vocabulary=5000):
    import random

    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]
