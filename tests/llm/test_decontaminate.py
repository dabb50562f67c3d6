from __future__ import annotations

import hashlib
import re

import pytest

from fleetlens.llm import decontaminate as D
from tests.llm.conftest import words


def split(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, items):
    w, hit, ids = split(text), set(), set()
    for item_id, item in items:
        v = split(item)
        k = min(10, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1):
            if v and tuple(w[i : i + k]) in grams:
                hit.update(range(i, i + k))
                ids.add(str(item_id))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.fixture
def items():
    long = words(40, 1)
    return [
        (1, " ".join(long)), (2, " ".join(long[:25])), (30, "Three little words"), (4, "one"), (5, ""), (6, None), (7, "É à b c d e f"),
        (8, " ".join(["the"] * 15)), (9, " ".join(["a", "b"] * 10)), (9, "twin item"), (None, " ".join(words(12, 8))),
    ]


@pytest.fixture
def rows():
    long = words(40, 1)
    texts = [
        " ".join(words(30, 50) + long[3:14] + words(30, 51)), " ".join(long), " ".join(long[:9]), "x-" + "?!".join(long[5:15]).upper(), "three LITTLE, words!",
        "One", "ones", "É à b c d e f", "é à b c d e f", "the " * 9, "the " * 12, "b a " * 12, " ".join(words(12, 8)), None, "", "...", "twin_item twin item",
        " ".join(words(60_000, 9) + long[20:31]),
    ]
    made = [(i, t, "en", "s") for i, t in enumerate(texts)]
    passage = " ".join(long[10:22])
    made += [(100 + i, " ".join(words(5, i)) + " " + passage, "en", "s") for i in range(40)]
    return [*made, (1, texts[1], "en", "s"), (1, "clean text here", "en", "s"), (None, texts[0], None, None)]


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_like_brute_force(spark, docs, rows, items, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_SHINGLES", broadcast)
    benchmark = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, n int")
    df = docs(*[(*r, 3, "w") for r in rows], extra=", n int, row string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.contamination(df, benchmark).collect()), key=str)
    known = [i for i in items if i[0] is not None]
    want = sorted(((r[0], *brute(r[1], known)) for r in rows), key=str)
    for g, w in zip(got, want, strict=True):
        # an item without an id marks words, but is not named
        assert g == w or (g[:2] == w[:2] and g[2] == 12 and g[3] == 0 and g[5])


def test_stage(spark, docs, rows, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = docs(*[(*r, 3) for r in rows], extra=", _t int")
    kept = D.clean(df, benchmark)
    assert kept.columns == df.columns
    want = sorted(str((r[0], r[1])) for r in rows if not brute(r[1], items)[4])
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == want


def test_empty(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    got = D.contamination(docs("a b", None), none).collect()
    assert [(r.n_hit, r.contaminated) for r in got] == [(0, False)] * 2
    assert D.contamination(docs(), none).count() == 0 and D.clean(docs("a"), none).count() == 1


def test_native(spark, docs):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = D.contamination(docs("a b c"), benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
