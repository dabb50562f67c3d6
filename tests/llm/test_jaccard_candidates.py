"""Pairs are refused on narrow rows: never one that is similar enough, nearly all that merely share a template."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import jaccard
from tests.llm.conftest import words


def tokens_of(texts):
    hashes = jaccard.WordHashes()
    return [jaccard.shingles(t.encode(), hashes) for t in texts]


def whole(spark, sets):
    return spark.createDataFrame([(i, len(s), s.view(np.int64).tolist()) for i, s in enumerate(sets)], "node long, n long, tokens array<long>")


def family(size, n_words=600, changed=10, seed=1):
    """Pages of one template, single words changed at places of their own: similarity about 0.72."""
    rng, template = random.Random(seed), words(n_words, seed)
    out = []
    for i in range(size):
        page = list(template)
        for at in rng.sample(range(n_words), changed):
            page[at] = f"own{i}x{at}"
        out.append(" ".join(page))
    return out


def similar(a, b):
    common = len(np.intersect1d(a, b))
    return 100 * common >= 80 * (len(a) + len(b) - common)


def test_parities_count_no_more_than_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 5, 31, 32, 33, 500, 3000):
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = np.unique(np.concatenate([a[: int(n * 0.9)], rng.integers(0, 2**64, n // 8 + 1, dtype=np.uint64)]))
        x, y = jaccard.parities(a), jaccard.parities(b)
        while len(x) != len(y):
            x, y = sorted((x, y), key=len)
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_no_similar_pair_is_refused(spark):
    rng, base = random.Random(2), [words(n, n) for n in (3, 5, 9, 40, 127, 128, 129, 300)]
    texts = []
    for text in base:
        for k in (0, 0, 1, 2, 5, 12):
            page = list(text)
            for at in rng.sample(range(len(page)), min(k, len(page))):
                page[at] = f"w{rng.randrange(50)}"
            texts.append(" ".join(page[: max(1, len(page) - rng.randrange(3))]))
    sets = tokens_of(texts)
    pairs = list(itertools.combinations(range(len(sets)), 2))
    got = {tuple(r) for r in jaccard.candidates(spark.createDataFrame(pairs, "a long, b long"), whole(spark, sets)).collect()}
    want = {(a, b) for a, b in pairs if similar(sets[a], sets[b])}
    assert want and want <= got


@pytest.mark.parametrize("size", [60, 250])
def test_pages_of_a_template_are_refused(spark, size):
    sets = tokens_of(family(size))
    pairs = spark.range(size).withColumnRenamed("id", "a").join(spark.range(size).withColumnRenamed("id", "b"), F.expr("a < b"))
    assert not similar(sets[0], sets[1])
    assert jaccard.candidates(pairs, whole(spark, sets)).count() < 0.05 * size * (size - 1) / 2


def test_a_family_whole(spark, docs):
    rows = [(i, t) for i, t in enumerate(family(120) + family(3, seed=9)[:1] * 2)]
    got = {r.doc_id: r.component_id for r in jaccard.linked(docs(*[(i, t, "en", "a") for i, t in rows])).collect()}
    assert got == {i: i if i < 121 else 120 for i in range(122)}
