"""Draws of the splitting tree follow the hypergeometric law at every size, and decide what a document gives to each shard."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from fleetlens.llm import mixing


@pytest.mark.parametrize(("good", "bad", "take"), [(5, 7, 6), (1, 9, 3), (30, 2, 29), (4, 4, 1)])
def test_small_draws_by_their_chances(good, bad, take):
    rng, n = np.random.default_rng(2), 20_000
    seen = Counter(mixing._hypergeometric(rng, good, bad, take) for _ in range(n))
    chances = {k: math.comb(good, k) * math.comb(bad, take - k) / math.comb(good + bad, take) for k in range(max(0, take - bad), min(good, take) + 1)}
    assert set(seen) <= set(chances)
    assert all(abs(seen[k] / n - p) < 5 * math.sqrt(p / n) + 1e-9 for k, p in chances.items())


@pytest.mark.parametrize("scale", [10**3, 10**6, 10**9, 10**11])
def test_large_draws_by_their_moments(scale):
    rng = np.random.default_rng(7)
    good, bad, take = 3 * scale, scale, 2 * scale
    drawn = np.array([mixing._hypergeometric(rng, good, bad, take) for _ in range(200 if scale < 10**9 else 20)], dtype=np.float64)
    deviation = math.sqrt(take * 0.75 * 0.25 * (good + bad - take) / (good + bad - 1))
    assert abs(drawn.mean() - 1.5 * scale) < 5 * deviation / math.sqrt(len(drawn))
    assert 0.4 * deviation < drawn.std() < 1.8 * deviation


def test_shards_make_up_what_is_taken(docs):
    rows = [(i, " ".join(["w"] * (i % 40 * 160 + i % 3)), "en", "abc"[i % 3]) for i in range(60)]
    want = Counter()
    for r in mixing.mixed_blocks(docs(*rows)).collect():
        want[r.doc_id, r.shard] += r.words
    got = mixing.mixed_sizes(docs(*rows)).collect()
    assert {(r.doc_id, s.shard): s.words for r in got for s in r.by_shard or ()} == dict(want)
    assert all(r.taken == sum(s.words for s in r.by_shard or ()) for r in got)


def test_clashing_columns(docs):
    df = docs((1, "a b c", "en", "x", 9, 9), (2, "d", "en", None, 9, 9), extra=", shard int, slot int")
    assert sorted(r.doc_id for r in mixing.mixed_blocks(df).select("doc_id").distinct().collect()) == [1, 2]
