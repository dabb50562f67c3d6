from __future__ import annotations

from collections import defaultdict

import pytest

from fleetlens.llm import substrings as S


def sentence(n, seed):
    import random

    draw = random.Random(f"{n}-{seed}")
    return " ".join(f"v{draw.randrange(10**6)}" for _ in range(n)) + "."


def brute(rows):
    """Kept words per distinct (doc_id, text)."""
    places, parts = defaultdict(set), {}
    for doc_id, text in set(rows):
        p = parts[doc_id, text] = S.sentences(text or "")
        n = len(p)
        spans = set()
        for i in range(n):
            j = next((j for j in range(i + S.SENTENCES, n + 1) if sum(len(x[2]) for x in p[i:j]) >= S.WORDS), None)
            if j:
                spans.add((i, j))
        for j in range(S.SENTENCES, n + 1):  # and the shortest up to each: together they cover what all runs do (test_substring_runs)
            i = next((i for i in range(j - S.SENTENCES, -1, -1) if sum(len(x[2]) for x in p[i:j]) >= S.WORDS), None)
            if i is not None:
                spans.add((i, j))
        for a, b in spans:
            places[tuple(w for x in p[a:b] for w in (*x[2], "|"))].add(((doc_id is not None, doc_id or 0), text, a, b))
    gone = defaultdict(set)
    for found in places.values():
        origin = min(x[0] for x in found)
        first = min((x for x in found if x[0] == origin), key=lambda x: x[2])
        for where in found - {first}:
            gone[where[0][1] if where[0][0] else None, where[1]].update(range(where[2], where[3]))
    return {k: [w for i, x in enumerate(p) if i not in gone[k] for w in x[2]] for k, p in parts.items()}


@pytest.fixture
def rows():
    passage = " ".join(sentence(n, f"p{n}") for n in (9, 12, 7, 11, 14, 8))
    long = sentence(120, "long")
    out = []
    for i in range(20):
        out.append((i, f"{sentence(10, i)} {passage} {sentence(9, -i)}\n{sentence(20, 100 + i)}"))
    out += [(30 + i, f"{sentence(4, i)}\nShared short line here.\n{sentence(30, 70 + i)}") for i in range(10)]
    out += [(50, long), (51, f"{sentence(3, 3)} {long}"), (52, out[3][1]), (53, "Of. The. A."), (54, "Of. The. A."), (55, None), (56, ""), (57, "... !! ?")]
    twice = f"{passage} {sentence(15, 'mid')} {passage}"
    return [*out, (60, twice), (60, twice), (None, out[1][1]), (61, f"{sentence(30, 'q')} " * 2000), (62, "é è " * 30_000)]


def test_like_brute_force(docs, rows):
    df = docs(*[(*r, "en", "s", 1, "z") for r in rows], extra=", first int, covered string").repartition(4)
    got = S.without_repeats(df).collect()
    want, texts = brute(rows), defaultdict(set)
    assert len(got) == len(rows)
    for k, w in want.items():
        texts[k[0]].add(tuple(w))
    for r in got:
        assert tuple((r.text or "").split()) in texts[r.doc_id], r.doc_id
    by = {r.doc_id: r for r in got}
    assert by[0].n_removed == 0 or None in by
    assert by[53].n_removed == by[54].n_removed == 0 and by[55].text is None and by[57].text == "... !! ?"
    assert all(by[i].n_removed == 0 for i in range(30, 40)), "short lines stay"
    assert by[51].text.split() == sentence(3, 3).split()
    assert by[52].text == "" and by[52].first_ids
    for r in got:
        assert r.n_removed == 0 or r.removed


def test_sentences():
    assert [x[2] for x in S.sentences("A b. C 3.5 d! e\nf")] == [["A", "b."], ["C", "3.5", "d!"], ["e"], ["f"]]
    assert [len(x[2]) for x in S.sentences("w " * 60)] == [25, 25, 10]
    assert S.runs([]) == [] and S.runs([30]) == [] and S.runs([30, 1]) == [(0, 2)] and S.runs([1] * 20) == []


def test_empty(docs):
    assert S.without_repeats(docs()).count() == 0
