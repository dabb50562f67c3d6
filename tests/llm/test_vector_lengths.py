from __future__ import annotations

import pytest

from fleetlens.llm import vectors as V
from tests.llm.test_vectors import brute, made


@pytest.mark.parametrize("group", [16_384, 40])
def test_each_length_is_joined(spark, monkeypatch, group):
    monkeypatch.setattr(V, "GROUP_ROWS", group)
    rows = {size: [(i if i is None else i + 10_000 * size, v) for i, v in made(size) if v is None or len(v) == size] for size in (1, 5, 16)}
    df = spark.createDataFrame([(i, v if v is None else [x if x is None else float(x) for x in v]) for some in rows.values() for i, v in some], "vec_id long, embedding array<double>").repartition(3)
    got = V.near_duplicates(df).collect()
    want = [x for size, some in rows.items() for x in brute(some, size)]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert all(any(n for i, n, _ in want if i is not None and i // 10_000 == size) for size in rows)
