from __future__ import annotations

import numpy as np
import pytest

from fleetlens.llm import vectors as V


@pytest.mark.parametrize("tile", [(128, 1_024), (3, 7), (1, 1)])
@pytest.mark.parametrize("same", [True, False])
def test_pairs_within_the_limit(monkeypatch, tile, same):
    monkeypatch.setattr(V, "STRIP", tile[0])
    monkeypatch.setattr(V, "TILE", tile[1])
    rng = np.random.default_rng(8)
    x = rng.standard_normal((160, 4)) / 4
    x[100:130] = x[5]
    left = np.ones(160, dtype=bool) if same else rng.random(160) < 0.5
    found = [pair for p, q in V._within(x, left, same, 0.05) for pair in zip(p.tolist(), q.tolist(), strict=True)]
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = {(i, j) for i, j in zip(*np.nonzero(far <= 0.05), strict=True) if (i < j if same else left[i] and not left[j])}
    got = {(min(p), max(p)) for p in found} if same else set(found)
    assert len(found) == len(got) and got == want and len(want) > 200


def test_few_rows_are_copied_between_slabs():
    """Coordinates lie around zero: no slab may end there, or half of the vectors go twice and most are compared in both."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    vecs = rng.standard_normal((2_000, 64))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(2_000)), pa.array(np.ones(2_000, dtype=np.int64)), pa.array([v.tobytes() for v in vecs], pa.binary())], ["node", "n", "vec"]
    )
    laid = pa.Table.from_batches(V._points(iter([batch]), 64, "float64"))
    assert laid.num_rows < 1.1 * 2_000 * V.BLOCKS
