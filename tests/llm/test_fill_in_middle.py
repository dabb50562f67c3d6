from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import fill_in_middle as M

UNITS = {M.CODE_POINT: "(?s).", M.WORD: r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", M.LINE: r"[^\n]*\n|[^\n]+"}


def brute(doc_id, text, unit=M.CODE_POINT):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in M.MARKS) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle = "".join(units[:a]), "".join(units[a:b])
    suffix = text[len(prefix) + len(middle) :]
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    draw = random.Random(7)
    out = ["", None, "x", " ", "a <P> b", "<S>", "<M", "é" * 9000, "\n\n", "\n", " \t a  b\r\n c ", "<<P <<S> <" * 3, "a\x00b", "🙂é" * 5000, "w " * 70_000]
    out += ["".join(draw.choices("ab<PSM> \né🙂あ", k=draw.randrange(200))) for _ in range(150)]
    return out


@pytest.mark.parametrize("unit", [M.CODE_POINT, M.WORD, M.LINE])
def test_like_brute_force(spark, docs, unit):
    rows = list(enumerate(texts())) + [(None, "no number"), (3, None), (2, "x"), (2, "x")]
    df = docs(*[(*r, "en", "s", 1, "z") for r in rows], extra=", form int, output string").repartition(3)
    got = M.fill_in_middle(df, unit).withColumn("text", M.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((brute(*r, unit) for r in rows), key=str)
    assert sorted(r.text for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_cuts_at_every_place():
    draw = random.Random(3)
    for unit, pattern in UNITS.items():
        for text in ["", "a", "  ", "\n", *("".join(draw.choices("ab \né🙂", k=k)) for k in range(1, 60))]:
            units = re.findall(pattern, text)
            whole = M.Cuttable(text.encode(), unit, block_bytes=4)
            assert (whole.n, whole.n_chars) == (len(units), len(text))
            for k in range(len(units) + 1):
                head = "".join(units[:k]) if k < len(units) or not units else text
                assert whole.cut(k) == (len(head.encode()), len(head)), (unit, text, k)


def test_tree_like_running_sums():
    rng = np.random.default_rng(1)
    for blocks in (1, 2, 3, 7, 8, 9, 100):
        units, chars = rng.integers(0, 4, blocks), rng.integers(0, 9, blocks)
        tree = M.Fenwick(units, chars)
        for unit in range(int(units.sum())):
            block = int(np.searchsorted(np.cumsum(units), unit, side="right"))
            assert tree.find(unit) == (block, unit - int(units[:block].sum()), int(chars[:block].sum()))


def test_batches_are_cut_by_size(docs, monkeypatch):
    monkeypatch.setattr(M, "BATCH_BYTES", 10)
    df = docs(*["abc def ghi"] * 40)
    assert M.fill_in_middle(df).count() == 40


def test_marks():
    df_marks = ("[[pre]]", "[[suf]]", "[[mid]]")
    with pytest.raises(ValueError):
        M._checked(("<P>", "<P>", "<M>"))
    with pytest.raises(ValueError):
        M._checked(("ab", "ba", "c"))
    with pytest.raises(ValueError):
        M._checked(("", "b", "c"))
    assert M._checked(df_marks) == df_marks


def test_other_marks(spark, docs):
    marks = ("⟦pre⟧", "⟦suf⟧", "⟦mid⟧")
    df = docs(*["one two three four", "⟦suf⟧ x", "<P> stays"] * 10)
    got = M.fill_in_middle(df, M.WORD, changed_percent=100, marks=marks)
    rows = got.withColumn("text", M.restored(F.col("output"), F.col("form"), marks)).collect()
    assert sorted(r.text for r in rows) == sorted(["one two three four", "⟦suf⟧ x", "<P> stays"] * 10)
    assert sum(r.form == "plain" for r in rows) == 10


def test_empty(docs):
    assert M.digests(docs()).count() == 0
    assert M.digests(docs(None, "", "abc")).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
