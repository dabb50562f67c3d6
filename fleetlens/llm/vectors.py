"""Embedding near-dedup by a subspace pigeonhole join.

Cosine c between unit vectors means squared distance 2 - 2c. Vectors are scaled to length one, rotated by a
fixed random rotation and split into ``BLOCKS`` blocks of neighbouring coordinates. If two vectors are within
the whole squared distance, at least one block is within its proportional part of it. So each block is
range-joined under its part: vectors are laid into slabs along the block's first coordinate, the slab as wide
as four radii, and those within a radius of the next slab are copied into it. Candidates of a block are
checked by their whole vectors in double precision. A pair that several blocks find counts in the first of
them only.

Equal vectors are one point with a multiplicity, so a group of copies is never expanded. A slab is not one
task: its rows are dealt into groups by a hash, and every pair of groups is a task of bounded size. Tasks return the number
of links per vector and a spanning forest of their links, not the links.

Cost: the filter keeps few pairs (one in some hundred thousand of unrelated ones), but in 16 dimensions a
radius of 0.22 spans most of a slab if the vectors have no direction of their own, and then tasks compare
most vectors with most others, four times in 16 dimensions: some nanoseconds a pair, but with the square of
the vectors. See the README for figures.

Vectors of each length are joined among themselves, with a rotation, blocks and parts of their own; vectors of
different lengths never link.

Defined results: null vectors, zero vectors and those with null or non-finite components link with nothing
and are components of their own; equal ids with equal vectors are two
vectors; a null id is a component's id only where no member has another.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import written
from fleetlens.llm.components import components

COSINE = 0.9
BLOCKS = 4
SLAB = 4.0  # radii
GROUP_ROWS = 16_384
#: Rows of a strip and of a tile: what one of them takes of the other fits a core's cache.
STRIP, TILE = 128, 1_024
SEED = 42
#: Above the error of single precision in a block's squared distance.
MARGIN = 1e-4


@lru_cache(maxsize=16)
def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def edges_of(size: int) -> np.ndarray:
    """Where blocks begin and end; sizes differ by one at most."""
    return np.linspace(0, size, min(BLOCKS, size) + 1).astype(int)


def budgets(size: int) -> np.ndarray:
    """Squared distance of each block, in proportion to its size."""
    return np.diff(edges_of(size)) / size * (2 - 2 * COSINE)


def unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # the squares of very small numbers are 0
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _unpacked(vecs: Iterable[bytes], size: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), dtype=kind).reshape(-1, size).astype(np.float64)


def _points(batches: Iterator[pa.RecordBatch], size: int, kind: str) -> Iterator[pa.RecordBatch]:
    """node, vec, block, slab, own (its home slab, or a copy in the one below)."""
    turn, cuts, part = rotation(size), edges_of(size), budgets(size)
    for batch in batches:
        vecs = batch.column("vec").to_pylist()
        if not vecs:
            continue
        x = unit(_unpacked(vecs, size, kind)) @ turn
        rows, blocks, slabs, own = [], [], [], []
        for b, radius in enumerate(np.sqrt(part)):
            at = x[:, cuts[b]] / (radius * SLAB) + 0.5  # most coordinates are near 0, and so in the middle of a slab
            home = np.floor(at).astype(np.int32)
            near = np.flatnonzero(at - home <= 1 / SLAB + 1e-9)
            rows += [np.arange(len(vecs)), near]
            blocks.append(np.full(len(vecs) + len(near), b, dtype=np.int32))
            slabs += [home, home[near] - 1]
            own += [np.ones(len(vecs), dtype=bool), np.zeros(len(near), dtype=bool)]
        taken = pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).take(taken) for c in ("node", "n", "vec")] + [pa.array(np.concatenate(c)) for c in (blocks, slabs, own)],
            ["node", "n", "vec", "block", "slab", "own"],
        )


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A mask of links that keeps what is connected connected."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = where[: len(a)], where[len(a) :]
    label, keep = np.arange(len(nodes)), np.zeros(len(a), dtype=bool)
    while True:
        lu, lv = label[u], label[v]
        open_ = np.flatnonzero(lu != lv)
        if not len(open_):
            return keep
        hi, lo = np.maximum(lu, lv)[open_], np.minimum(lu, lv)[open_]
        # each root hooks to one smaller root
        roots, first = np.unique(hi, return_index=True)
        keep[open_[first]] = True
        label[roots] = lo[first]
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _within(small: np.ndarray, left: np.ndarray, same: bool, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the left and of the right side whose squared distance may be within the limit; each pair once.

    Rows are taken in the order of the first coordinate, and only those within reach of a strip of left rows are
    compared with it. The distances of a tile come from one product, |a|^2 + |b|^2 - 2 ab, and stay in the cache.
    """
    sides = []
    for rows in (np.flatnonzero(left), np.flatnonzero(left if same else ~left)):
        rows = rows[np.argsort(small[rows, 0], kind="stable")]
        x = small[rows].astype(np.float32)
        sides.append((rows, small[rows, 0], x, (x * x).sum(axis=1), np.ones(len(rows), dtype=np.float32)))
    (ia, along_a, xa, square_a, one_a), (ib, along_b, xb, square_b, one_b) = sides
    lead, follow = np.column_stack([-2 * xa, square_a, one_a]), np.column_stack([xb, one_b, square_b])
    begin = np.searchsorted(along_b, along_a - np.sqrt(limit))
    end = np.searchsorted(along_b, along_a + np.sqrt(limit), side="right")
    space, waiting, size = np.empty(STRIP * TILE, dtype=np.float32), [], 0
    for s in range(0, len(ia), STRIP):
        a = lead[s : s + STRIP]
        stop = end[s + len(a) - 1]
        for t in range(max(s, begin[s]) if same else begin[s], stop, TILE):
            b = follow[t : min(t + TILE, stop)]
            far = np.matmul(a, b.T, out=space[: len(a) * len(b)].reshape(len(a), len(b)))
            some = np.flatnonzero(far.min(axis=1) <= limit)
            if not len(some):
                continue
            i, j = np.nonzero(far[some] <= limit)
            i, j = some[i] + s, j + t
            if same:
                i, j = i[i < j], j[i < j]
            waiting.append((ia[i], ib[j]))
            size += len(i)
            if size >= 65_536:
                yield tuple(np.concatenate(c) for c in zip(*waiting, strict=True))
                waiting, size = [], 0
    if size:
        yield tuple(np.concatenate(c) for c in zip(*waiting, strict=True))


def _tile_links(pdf: pd.DataFrame, size: int, block: int, same: bool, kind: str) -> pd.DataFrame:
    """Links found in one pair of groups of a slab: (a, b, links). Counts have b null, links are a forest."""
    turn, cuts, part = rotation(size), edges_of(size), budgets(size)
    node, own, weight, left = (pdf[c].to_numpy() for c in ("node", "own", "n", "left"))
    raw = unit(_unpacked(pdf["vec"], size, kind))
    found_a, found_b = [], []
    for p, q in _within(raw @ turn[:, cuts[block] : cuts[block + 1]], left, same, part[block] + MARGIN):
        # one of them at home in the slab; each pair once
        good = own[p] | own[q]
        p, q = p[good], q[good]
        close = (raw[p] * raw[q]).sum(axis=1) >= COSINE
        p, q = p[close], q[close]
        if len(p):
            parts = np.add.reduceat(((raw[p] - raw[q]) @ turn) ** 2, cuts[:-1], axis=1)
            first = (parts <= part + 1e-9).argmax(axis=1) == block
            found_a.append(p[first])
            found_b.append(q[first])
    if not found_a:
        return pd.DataFrame({"a": [], "b": [], "links": []})
    p, q = np.concatenate(found_a), np.concatenate(found_b)
    counts = np.bincount(p, weight[q], len(pdf)) + np.bincount(q, weight[p], len(pdf))
    some = np.flatnonzero(counts)
    kept = _forest(node[p], node[q]) if len(p) else np.zeros(0, dtype=bool)
    return pd.DataFrame(
        {
            "a": np.concatenate([node[some], node[p[kept]]]),
            "b": np.concatenate([np.full(len(some), -1), node[q[kept]]]),
            "links": np.concatenate([counts[some].astype(np.int64), np.zeros(int(kept.sum()), dtype=np.int64)]),
        }
    )


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    single = embeddings.schema["embedding"].dataType == T.ArrayType(T.FloatType())
    kind = "float32" if single else "float64"  # as it came, to move no more than that
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("good", good)
    # -0.0 and 0.0 are one value to the digest, and the row number stands for the vector from here on
    plain = F.transform("embedding", lambda v: v + F.lit(0.0))
    rows = rows.withColumn("embedding", F.when(F.col("good"), plain)).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    rows = written(rows, "vectors")
    points = rows.where("good").groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    if not rows.where("good").isEmpty():
        links = written(_links(rows.join(points.select("node", "n"), F.col("row") == F.col("node")), kind), "vector-links")
        joined = components(links.where("b >= 0"), "a", "b", "vector-components")
        counts = links.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    else:
        joined = points.select("node", F.col("node").alias("component"))
        counts = points.select("node", F.lit(0).cast("long").alias("links"))
    known = points.join(joined, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(ids, "component").select(
        "h1", "h2", "component_id", (F.coalesce("links", F.lit(0).cast("long")) + F.col("n") - 1).alias("n_links")
    )
    linked = rows.where("good").select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(points: DataFrame, kind: str) -> DataFrame:
    """(a, b, links): links between nodes; rows with b = -1 count a's links in one task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mixed in batches:
            sizes = pc.list_value_length(mixed.column("embedding"))
            for size in pc.unique(sizes).to_pylist():
                batch = mixed.filter(pc.equal(sizes, size))
                flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
                vecs = pa.array([v.tobytes() for v in np.ascontiguousarray(flat, dtype=kind)], pa.binary())
                for laid in _points(iter([pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), vecs], ["node", "n", "vec"])]), size, kind):
                    yield pa.RecordBatch.from_arrays([*laid.columns, pa.array(np.full(laid.num_rows, size, dtype=np.int32))], [*laid.schema.names, "size"])

    laid = points.select("node", "n", "embedding").mapInArrow(pack, "node long, n long, vec binary, block int, slab int, own boolean, size int")
    groups = max(1, -(-points.count() // GROUP_ROWS))
    laid = laid.withColumn("g", F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int"))
    # every pair of groups of a slab: as the left side with all groups from its own on, as the right one with those before
    paired = laid.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    left = F.col("g") <= F.col("with")
    paired = paired.select(
        "node", "n", "vec", "size", "block", "slab", "own", left.alias("left"),
        F.least("g", "with").alias("i"), F.greatest("g", "with").alias("j"),
    )

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size, block, _, i, j = (int(k) for k in key)
        return _tile_links(pdf, size, block, i == j, kind)

    return paired.groupBy("size", "block", "slab", "i", "j").applyInPandas(tile, "a long, b long, links long")
