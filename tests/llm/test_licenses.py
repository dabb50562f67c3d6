from __future__ import annotations

import difflib

import pytest

from fleetlens.llm import licenses as L
from tests.llm.conftest import words

INDEX = L.Index(L.TEMPLATES)


def found(text, **more):
    return {(m[0], text[m[4] : m[5]]) for m in L.matches(text.encode(), INDEX, **more)}


def test_whole_and_changed():
    grant = L.TEMPLATES["MIT-grant"]
    assert found("Ébc. released  UNDER a\nMIT licénse… Released under the MIT License.") == {("MIT", "Released under the MIT License")}
    broken = grant.replace("free of charge", "gratis").replace("sublicense, ", "").replace("persons", "the persons")
    text = " ".join(words(50, 1)) + " " + broken + " " + " ".join(words(50, 2))
    assert found(text) == {("MIT-grant", broken.rstrip(":"))}
    assert found(" ".join(words(5000, 3))) == set() and found("under the MIT License") == {("MIT", "under the MIT License")}
    assert found(grant[: len(grant) // 2]) == set()


def test_every_template_and_repeats():
    text = ("x y z " * 7).join(L.TEMPLATES.values())
    assert {m[0] for m in L.matches(text.encode(), INDEX)} == set(L.TEMPLATES)
    line = L.TEMPLATES["CC-BY-NC-4.0"]
    assert len(L.matches((line + " filler words between them here ").encode() * 50, INDEX)) == 50


@pytest.mark.parametrize("seed", range(30))
def test_alignment_like_a_common_subsequence(seed):
    import random

    draw = random.Random(seed)
    template = [b"%d" % draw.randrange(50) for _ in range(40)]
    text = [w for w in template if draw.random() > 0.08]
    for _ in range(3):
        text.insert(draw.randrange(len(text)), b"new")
    n, first, last = L.align(template, [b"q"] * 20 + text + [b"q"] * 20, 20)
    longest = sum(b.size for b in difflib.SequenceMatcher(None, template, text, autojunk=False).get_matching_blocks())
    assert longest <= n <= len(template) and 20 <= first <= last < 20 + len(text)


def test_shared_runs_share_fingerprints():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        run = rng.integers(0, 2**63, L.GRAM + L.WINDOW - 1).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 2**63, 30).astype(np.uint64), run, rng.integers(0, 2**63, 9).astype(np.uint64)]) for _ in "ab")
        assert set(L.fingerprints(a)[1]) & set(L.fingerprints(b)[1])


def test_rows(docs):
    line = "Licensed under CC BY-NC 4.0."
    df = docs(*[(*r, "x") for r in [(1, line, "en", "a"), (1, line, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "a b " * 30_000 + line, "en", "a")]], extra=", license string")
    got = L.scan(df).collect()
    assert sorted(str((r.doc_id, r.license, r.start, r.end)) for r in got) == sorted(["(1, 'CC-BY-NC-4.0', 0, 27)"] * 2 + ["(None, 'CC-BY-NC-4.0', 120000, 120027)"])
    assert all(r.coverage == 1.0 and r.matched_words == r.template_words for r in got)
    assert L.scan(docs()).count() == 0
    with pytest.raises(ValueError, match="no words"):
        L.scan(df, {"x": "..."})
    assert L.scan(df, {}).count() == 0
