from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from fleetlens.llm import codes as C
from fleetlens.llm.common import looked_up

SCHEMA = "vec_id long, embedding array<double>, label int, size int, part string"


def cut(v):
    long, at, out = len(v) % 4, 0, []
    for p in range(4):
        end = at + len(v) // 4 + (p < long)
        out.append(tuple(v[at:end]))
        at = end
    return out


def brute(rows):
    """The contract in plain whole numbers, for each length by itself."""
    by_size = defaultdict(list)
    for vec_id, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            by_size[len(v)].append((vec_id, v, label))
    out, labels = [], defaultdict(int)
    for kept in by_size.values():
        kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        parts = [cut([max(-(1 << 26), min(1 << 26, math.floor(1024 * x))) for x in v]) for _, v, _ in kept]
        books = [[p[i] for p in parts[:256]] for i in range(4)]

        def nearest(part, book):
            return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), i) for i, entry in enumerate(book))

        for _ in range(4):
            for i in range(4):
                groups = defaultdict(list)
                for p in parts:
                    groups[nearest(p[i], books[i])[1]].append(p[i])
                books[i] = [tuple(sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)) if e in groups else entry for e, entry in enumerate(books[i])]
        sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
        for (vec_id, _, label), p in zip(kept, parts, strict=True):
            found = [nearest(p[i], books[i]) for i in range(4)]
            error = sum(f[0] for f in found)
            labels[label] += error
            out.append((vec_id, "".join(f"{f[1]:02x}" for f in found), error, label, sha))
    return sorted(((i, c, e, labels[lab], s) for i, c, e, lab, s in out), key=str)


def made():
    draw = random.Random(11)
    rows = [(i, [draw.gauss(0, 1) for _ in range(8)], draw.randrange(3)) for i in range(400)]
    rows += [(i, [draw.choice([0.0, 0.5, -0.25]) for _ in range(8)], None) for i in range(400, 600)]  # many equal prefixes and copies
    rows += [(i, rows[3][1], 7) for i in range(600, 700)] + [(5, rows[9][1], 1), (5, rows[9][1], 1), (5, None, 1), (None, rows[1][1], 1), (None, None, None)]
    rows += [(700, [float("nan")] * 8, 1), (701, [None] + [1.0] * 7, 1), (702, [float("inf")] + [0.0] * 7, 1), (703, [1e300, -1e300, -1e-9, -0.0, 0.0, 1e-9, 5e4, -7e4], 1)]
    rows += [(800 + i, [draw.gauss(0, 1) for _ in range(6)], 2) for i in range(40)] + [(900, [], 2), (901, [], 3), (902, [0.3], 3), (903, [-0.3], 3)]
    return rows


@pytest.mark.parametrize("rows_per_trie", [32_768, 50])
def test_like_brute_force(spark, monkeypatch, rows_per_trie):
    monkeypatch.setattr(C, "TRIE_ROWS", rows_per_trie)
    monkeypatch.setattr(C, "LEAVES", 4)
    rows = made()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    got = C.compressed(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_walk_takes_the_first_of_the_nearest():
    rng = np.random.default_rng(2)
    for size in (0, 1, 3, 16):
        parts = np.unique(rng.integers(-3, 4, (700, size)), axis=0) if size else np.zeros((1, 0), dtype=np.int64)
        book = rng.integers(-3, 4, (20, size))
        book[7] = book[3]
        far = ((parts[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        codes, errors = C.walk(parts, book)
        assert (codes == far.argmin(axis=1)).all() and (errors == far.min(axis=1)).all()


def test_single_precision(spark):
    rows = [(i, [float(np.float32(x)) for x in np.random.default_rng(i).standard_normal(8)], 0) for i in range(30)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA.replace("double", "float"))
    assert sorted((tuple(r) for r in C.compressed(df).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert C.compressed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.compressed(spark.createDataFrame([(1, None, 1, 1, "x"), (2, [None], 1, 1, "x")], SCHEMA)).count() == 0


def test_looked_up(spark):
    rows = [(None if i % 50 == 0 else i % 3, i, "z") for i in range(300)] + [(9, 1, "gone")]
    df = spark.createDataFrame(rows, "k int, v int, _salt string").repartition(3)
    found = spark.createDataFrame([(None, 100), (0, 7), (1, 8), (2, 9), (4, 5)], "k int, w int")
    got = sorted(tuple(r) for r in looked_up(df, found, ["k"], salts=4).select("v", "_salt", "w").collect())
    assert got == sorted((v, s, {None: 100, 0: 7, 1: 8, 2: 9}[k]) for k, v, s in rows if k != 9)
