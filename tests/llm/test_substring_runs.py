from __future__ import annotations

import random
from collections import defaultdict

import pytest

from fleetlens.llm import substrings as S


def every(lengths):
    n = len(lengths)
    return [(a, b) for a in range(n) for b in range(a + S.SENTENCES, n + 1) if sum(lengths[a:b]) >= S.WORDS]


@pytest.mark.parametrize("seed", range(40))
def test_cover_every_run(seed):
    draw = random.Random(seed)
    lengths = [draw.randrange(1, (4, 14, 26)[seed % 3]) for _ in range(draw.randrange(1, 40))]
    got, all_runs = S.runs(lengths), every(lengths)
    assert set(got) <= set(all_runs) and len(got) == len(set(got)) <= 2 * len(lengths)
    for a, b in all_runs:
        assert {i for x, y in got if a <= x and y <= b for i in range(x, y)} == set(range(a, b))


def test_middle_of_a_text(docs):
    draw = random.Random(3)

    def sentence(n):
        return " ".join(f"v{draw.randrange(10**6)}" for _ in range(n)) + "."

    shared = " ".join(sentence(n) for n in (20, 10, 8))
    rows = [(i, f"{sentence(11)} {shared} {sentence(12)} {sentence(9)}") for i in range(5)]
    got = {r.doc_id: r.text for r in S.without_repeats(docs(*[(*r, "en", "s") for r in rows])).collect()}
    assert got[0] == rows[0][1]
    for i, text in rows[1:]:
        assert got[i] == text.replace(f"{shared} ", ""), i


def test_like_all_runs(docs):
    """Against every run of every length; a place of the least document that holds a run stays."""
    draw = random.Random(4)
    pool = [" ".join(f"p{k}x{j}" for j in range(draw.randrange(3, 13))) + "." for k in range(40)]
    texts = [" ".join(pool[(draw.randrange(40) + j) % 40] for j in range(2)) + " " + " ".join(pool[a : a + draw.randrange(3, 9)]) for a in (draw.randrange(30) for _ in range(30))]
    parts, places = [S.parts_of(t) for t in texts], defaultdict(list)
    for i, p in enumerate(parts):
        for a, b in every([len(x) for x in p]):
            places[tuple(w for x in p[a:b] for w in (*x, "|"))].append((i, a, b))
    gone = defaultdict(set)
    for found in places.values():
        for i, a, b in sorted(found)[1:]:
            gone[i].update(range(a, b))
    got = {r.doc_id: r for r in S.without_repeats(docs(*texts)).collect()}
    for i, p in enumerate(parts):
        assert got[i].text.split() == [w for k, x in enumerate(p) if k not in gone[i] for w in x], i
