from __future__ import annotations

import random

import pytest

from fleetlens.llm import substrings as S


def found(text):
    """The words of every hashed run."""
    parts = [x[2] for x in S.sentences(text)]
    assert parts == S.parts_of(text)
    return {tuple(w for p in parts[a:b] for w in (*p, "|")) for a, b in S.runs([len(p) for p in parts])}


@pytest.mark.parametrize("seed", range(60))
def test_passages_at_any_place(seed):
    draw = random.Random(seed)
    some = [f"w{i}" for i in range((3, 30, 5000)[seed % 3])]

    def words(n):
        return [draw.choice(some) + draw.choice(("", "", "", "", "", ".") if seed % 2 else ("",)) for _ in range(n)]

    passage = words(50)
    if seed % 5 == 0:
        passage = (draw.sample([f"v{i}" for i in range(20)], 2 + seed // 5) * 50)[:50]
    texts = [" ".join([*(f"{i}{w}" for w in words(draw.randrange(40))), *passage, *(f"{i}{w}" for w in words(draw.randrange(40)))]) for i in range(2)]
    assert found(texts[0]) & found(texts[1])


def test_one_word_over_and_over():
    assert found("x " + "w " * 75 + "y") & found("w " * 90) and [len(x[2]) for x in S.sentences("w " * 51)] == [25, 25, 1]


@pytest.mark.parametrize(("low", "high"), [(0x4E00, 0x9FFF), (0x0E01, 0x0E30)])
def test_without_blanks(low, high):
    draw = random.Random(7)

    def characters(n):
        return "".join(chr(draw.randrange(low, high)) for _ in range(n))

    passage = characters(60)
    assert found(characters(17) + passage + characters(30)) & found(characters(4) + passage + characters(9))
    assert [t[a:b] for t in ("好。不好！No? 是",) for a, b, _ in S.sentences(t)] == ["好。", "不好！", "No?", "是"]
    assert [x[2] for x in S.sentences("กี่ ab中c")] == [["กี่", "ab", "中", "c"]]


def test_long_words():
    draw = random.Random(8)

    def letters(n):
        return "".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))

    passage = letters(500)
    assert found(letters(170) + passage + letters(30)) & found(letters(4) + passage + letters(9))
    assert [x[2] for x in S.sentences("a" * 250 + " b")] == [["a" * 250, "b"]]


def test_removed(docs):
    draw = random.Random(9)
    passage = " ".join(f"v{draw.randrange(10**6)}" for _ in range(60))
    characters = "".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(60))
    df = docs(f"a b c {passage} d e", f"{' '.join(f'u{i}' for i in range(37))} {passage} f.", f"一二三{characters}四五", f"六{characters}七八九十")
    got = {r.doc_id: r for r in S.without_repeats(df).collect()}
    assert got[0].n_removed == got[2].n_removed == 0
    assert got[1].text.startswith(" ".join(f"u{i}" for i in range(37))) and got[1].text.endswith(" f.")
    assert len(got[1].text.split()) <= 38 + 25 and got[1].first_ids == [0]
    assert got[3].text.startswith("六") and got[3].text.endswith("七八九十") and len(got[3].text) <= 5 + 25
