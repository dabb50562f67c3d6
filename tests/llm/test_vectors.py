from __future__ import annotations

import numpy as np
import pytest

from fleetlens.llm import vectors as V


def made(size=16):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, size))
    rows = []
    for b in base[:4]:
        for scale in (0.02, 0.1, 0.2, 0.25, 0.3):
            rows += [list(b + scale * rng.standard_normal(size)) for _ in range(8)]
    rows += [list(v) for v in rng.standard_normal((60, size))]
    rows += [list(base[5])] * 30 + [list(base[5] * 3)] * 5 + [list(-base[5])]
    out = list(enumerate(rows))
    out += [(500, None), (501, [0.0] * size), (502, [float("nan")] * size), (503, [float("inf")] + [1.0] * (size - 1)), (504, [None] + [1.0] * (size - 1))]
    return [*out, (505, [1.0]), (506, []), (0, rows[0]), (None, rows[0]), (507, [1e-300 * 0] * (size - 1) + [1e-200]), (507, [-0.0] * (size - 1) + [1.0]), (508, [0.0] * (size - 1) + [1.0])]


def brute(rows, size):
    good = [v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    x = np.array([v if g else [1.0] * size for (_, v), g in zip(rows, good, strict=True)], dtype=float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = (x @ x.T >= V.COSINE) & np.outer(good, good)
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(rows)).min(axis=1))
        if (new == label).all():
            break
        label = new
    ids = {}
    for (i, _), c in zip(rows, label, strict=True):
        if i is not None:
            ids[c] = min(i, ids.get(c, i))
    return sorted(((i, int(n), ids.get(c)) for (i, _), n, c in zip(rows, near.sum(axis=1), label, strict=True)), key=str)


@pytest.mark.parametrize("kind", ["double", "float"])
@pytest.mark.parametrize("group", [16_384, 40])
def test_like_brute_force(spark, monkeypatch, kind, group):
    monkeypatch.setattr(V, "GROUP_ROWS", group)
    monkeypatch.setattr(V, "TILE", 16)
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in made()]
    if kind == "float":
        rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
        rows = [r for r in rows if r[1] is None or len(r[1]) < 16 or r[0] != 507]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, node int").repartition(4)
    got = V.near_duplicates(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows, 16)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_budgets_cover_the_distance():
    for size in (1, 3, 16, 64):
        assert V.budgets(size).sum() == pytest.approx(2 - 2 * V.COSINE)
        r = V.rotation(size)
        assert np.allclose(r @ r.T, np.eye(size))


def test_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert V.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = V.near_duplicates(spark.createDataFrame([(1, None, 0), (2, [], 0)], schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]
