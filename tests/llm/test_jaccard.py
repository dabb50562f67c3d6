from __future__ import annotations

import itertools

import pytest

from fleetlens.llm import jaccard
from tests.llm.conftest import words


def sets_of(text):
    w = text.encode().lower().split() if text else []
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    """(doc_id, n_shingles, component_id) per row, and the component ids of rows with words, one per component."""
    sets = [sets_of(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
            up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    each = sorted(((r[0], len(sets[i]), least.get(root(i))) for i, r in enumerate(rows)), key=str)
    return each, [least.get(i) for i in range(len(rows)) if sets[i] and root(i) == i]


@pytest.fixture(scope="module")
def rows():
    out = []
    base = words(120, 1)
    for k in range(25):  # a group of near copies, some of them near only through others
        copy = list(base)
        for p in range(k % 6):
            copy[(k * 7 + p * 31) % 120] = f"n{k}_{p}"
        out.append(" ".join(copy))
    passage = words(60, 2)
    for k in range(25):  # a passage that many hold, with more or less beside it
        out.append(" ".join(passage + words(3 + k, 100 + k, 10**6)))
    chain = words(60, 3)
    for k in range(12):
        out.append(" ".join(chain[k : k + 40]))
    out += [" ".join(words(80, 200 + k)) for k in range(30)]
    out += ["Short one", "short  ONE", "short one É", "short one é", "a b c d", "a b c d e", "", None, "\t\n", "x " * 3000, "X\n" * 2999 + "x"]
    made = [(i, t, "en", "s") for i, t in enumerate(out)]
    made += [(0, out[0], "en", "s"), (0, out[0], "de", "s"), (3, out[40], "en", "s"), (None, out[0], None, None), (None, "only here with no id at all", None, None)]
    made += [(900 + i, " ".join(words(90, 7)), "en", "s") for i in range(40)]
    made.append((-5, " ".join(words(60, 12) + [chr(233) * 9] * 20_000), "en", "s"))
    return made


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_like_brute_force(docs, rows, monkeypatch, broadcast):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", broadcast)
    df = docs(*[(*r, 1, "t") for r in rows], extra=", row int, token string").repartition(5)
    got = jaccard.linked(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)[0]


def test_one_of_each_stays(docs, rows):
    df = docs(*[(*r, 1) for r in rows], extra=", _k int")
    kept = jaccard.deduplicated(df)
    assert kept.columns == df.columns
    each, groups = brute(rows)
    got = kept.collect()
    assert len([r for r in got if not sets_of(r.text)]) == sum(not n for _, n, _ in each)
    assert sorted((r.doc_id for r in got if sets_of(r.text)), key=str) == sorted(groups, key=str)


def test_hashes_find_what_tuples_find():
    import numpy as np

    h = jaccard.WordHashes()
    for text in ["a b c d e f a b c d e", "A  b\tc", "x", " ".join(words(500, 9, 30))]:
        assert len(jaccard.shingles(text.encode(), h)) == len(sets_of(text))
    assert np.array_equal(jaccard.shingles(b"A B C D E", h), jaccard.shingles(b"a b c\nd e", h))
    assert [jaccard.prefix_length(n) for n in (1, 4, 5, 10)] == [1, 1, 2, 3]


def test_empty(docs):
    assert jaccard.linked(docs()).count() == 0 and jaccard.deduplicated(docs()).count() == 0
    assert [r.component_id for r in jaccard.linked(docs(None, "")).orderBy("doc_id").collect()] == [0, 1]
