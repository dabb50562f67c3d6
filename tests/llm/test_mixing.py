from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from fleetlens.llm import mixing


def test_targets():
    owed = mixing.targets([100, 100, 100, 0], [5, 2, 1, 5])
    assert owed[0] == 200 and owed[3] == 0 and sum(owed) == pytest.approx(450)
    assert owed[1] == pytest.approx(2 * owed[2]) and max(owed[1:3]) <= 200
    assert mixing.targets([], []) == [] and mixing.targets([0], [5]) == [0.0]
    assert mixing.targets([10, 10], [5, 2]) == pytest.approx([20.0, 10.0])


def test_tree_is_exact():
    tree = mixing.splitting_tree([1000, 31, 0, 5], 7, 1)
    assert [sum(c) for c in zip(*tree, strict=True)] == [1000, 31, 0, 5]
    totals = [sum(shard) for shard in tree]
    assert max(totals) - min(totals) <= 3 and all(min(shard) >= 0 for shard in tree)


def test_large_totals_are_split():
    tree = mixing.splitting_tree([3 * 10**9, 10**9], 4, 1)
    assert [sum(c) for c in zip(*tree, strict=True)] == [3 * 10**9, 10**9]
    assert all(abs(shard[0] - 0.75e9) < 1e6 for shard in tree)


@pytest.fixture
def rows():
    out = [(i, " ".join(["w"] * (i % 40 * 60 + i % 3)), "en", "abc"[i % 3]) for i in range(120)]
    return [*out, (None, "one two", None, None), (500, None, "en", "a"), (501, "", "en", "z"), *[(7, "x y z", "en", "a")] * 20]


def test_words_near_targets(docs, rows):
    got = mixing.mixed_sizes(docs(*rows)).collect()
    assert len(got) == len(rows)
    taken, target, size = Counter(), {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        # the source can be told from its size
        taken[r.source_size] += r.taken
        target[r.source_size], size[r.source_size] = r.target, r.source_size
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.5 and t <= 2 * s + 1e-9
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_sizes(docs(*rows).repartition(7)).collect()))


def test_draws_are_disjoint_and_meet_quotas(docs, rows):
    units = mixing.with_units(docs(*rows), ["doc_id"])
    assert units.select("unit").distinct().count() == len(rows)
    drawn = mixing.mix(units, block_words=64, shards=4)[0].collect()
    assert len({(r.unit, r["pass"], r.block) for r in drawn}) == len(drawn)
    per_shard = Counter(r.shard for r in drawn)
    assert set(per_shard) == {0, 1, 2, 3} and max(per_shard.values()) - min(per_shard.values()) <= 2


def test_mixed_documents(docs, rows):
    df = docs(*[(*r, 1, "x") for r in rows], extra=", size int, unit string")
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    found, sizes = defaultdict(int), defaultdict(int)
    for r in got.collect():
        assert r.n_chars == len(r.text)
        found[r.source] += len(r.text.split())
    by = {(r.source_size): r.target for r in mixing.mixed_sizes(docs(*rows)).collect()}
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    for source, n in sizes.items():
        assert abs(found[source] - by[n]) <= 0.5


def test_empty(docs):
    assert mixing.mixed_sizes(docs()).count() == 0
    assert mixing.mixed_documents(docs()).count() == 0
    assert mixing.mixed_sizes(docs(None, "")).count() == 2
