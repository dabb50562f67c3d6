"""Vector code compression: vectors become four code bytes, learned with whole numbers only.

Components are floor(1024 x). A vector is cut into four consecutive parts, each with a codebook of up to 256
entries that starts as the parts of the smallest vec_ids. A round assigns every part to its nearest entry and
moves each entry to the floor of the mean of its parts; after four rounds the parts are assigned a last time.

Nearest entries come from a lexicographic trie over the distinct parts of a stretch of rows. It is walked
depth-first: a node carries the distances of its prefix to all entries, summed over the dimensions so far, so
parts with a common prefix share them. Where few leaves are left below a node they end together. Leaves
take the first of the nearest entries, and with the number of rows behind them, sums per entry.

Vectors aren't shuffled: a task builds tries of up to ``TRIE_ROWS`` rows of its own and puts out sums per entry, which
Spark adds up. What passes through the driver is the codebooks, which are bounded by their size: 256 entries per
part, so 1024 numbers for each dimension. Copies of a vector are one leaf per trie, whatever their number.

Defined results: vectors that are null or hold null or non-finite components go. Each length of vector has
codebooks of its own; where it isn't divisible by four the first parts are longer by one, and parts without
dimensions have code 0 and no error. Fewer than 256 vectors give as many entries; equal entries are legal and the
first is taken. Rows with equal vec_ids are ordered by vector, a null vec_id comes last. Whole numbers beyond
2^26 (components beyond 65 536) stay at 2^26, so that all distances fit into 64 bits. An empty table gives an
empty one; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import looked_up, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
MOST = 1 << 26
TRIE_ROWS = 32_768
#: Leaves below a node that are ended together.
LEAVES = 128

#: For each length of vectors its codebooks, one array (entries, dimensions) per part.
Codebooks = dict[int, list[np.ndarray]]


def edges_of(size: int) -> np.ndarray:
    """Where parts begin and end."""
    long = size % PARTS
    return np.cumsum([0] + [size // PARTS + (p < long) for p in range(PARTS)])


def whole_numbers(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def walk(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part and its squared distance. Parts are distinct and in lexicographic order."""
    rows, size = parts.shape
    codes, errors = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
    columns = np.ascontiguousarray(book.T)
    nodes = [(0, rows, 0, np.zeros(len(book), dtype=np.int64))]
    while nodes:
        lo, hi, depth, sums = nodes.pop()
        if hi - lo <= LEAVES or depth == size:
            far = np.repeat(sums[None, :], hi - lo, axis=0)
            for d in range(depth, size):
                step = parts[lo:hi, d, None] - columns[d]
                step *= step
                far += step
            nearest = far.argmin(axis=1)
            codes[lo:hi] = nearest
            errors[lo:hi] = far[np.arange(hi - lo), nearest]
            continue
        values = parts[lo:hi, depth]
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [hi - lo]])
        for a, b in zip(starts[::-1].tolist(), ends[::-1].tolist(), strict=True):
            step = values[a] - columns[depth]
            nodes.append((lo + a, lo + b, depth + 1, sums + step * step))
    return codes, errors


def _assigned(vectors: np.ndarray, books: Sequence[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: its number, the distinct parts with codes and errors, and for each vector its leaf."""
    cuts = edges_of(vectors.shape[1])
    for p, book in enumerate(books):
        parts = vectors[:, cuts[p] : cuts[p + 1]]
        if parts.shape[1]:
            leaves, leaf = np.unique(parts, axis=0, return_inverse=True)
        else:
            leaves, leaf = parts[:1], np.zeros(len(parts), dtype=np.int64)
        codes, errors = walk(leaves, book)
        yield p, leaves, codes, errors, leaf.reshape(-1)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, np.ndarray]]:
    """Up to TRIE_ROWS rows of one length of vectors at a time: the length, the rows, the vectors in whole numbers."""
    waiting: list[pa.RecordBatch] = []

    def out() -> Iterator[tuple[int, pa.Table, np.ndarray]]:
        rows = pa.Table.from_batches(waiting)
        sizes = pc.list_value_length(rows.column("embedding"))
        for size in pc.unique(sizes).to_pylist():
            same = rows.filter(pc.equal(sizes, size)).combine_chunks()
            flat = np.concatenate([np.asarray(c.flatten()) for c in same.column("embedding").chunks])
            yield size, same, whole_numbers(flat.reshape(same.num_rows, size))

    for batch in batches:
        for start in range(0, batch.num_rows, TRIE_ROWS):
            waiting.append(batch.slice(start, TRIE_ROWS))
            if sum(b.num_rows for b in waiting) >= TRIE_ROWS:
                yield from out()
                waiting = []
    if waiting:
        yield from out()


def _sums(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sums: size, part, entry, dimension (-1: the number of rows) and total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for size, _, vectors in _stretches(batches):
            for p, leaves, codes, _, leaf in _assigned(vectors, books[size]):
                weights = np.bincount(leaf, minlength=len(leaves))
                found = totals.setdefault((size, p), np.zeros((len(books[size][p]), leaves.shape[1] + 1), dtype=np.int64))
                np.add.at(found, codes, np.column_stack([weights, leaves * weights[:, None]]))
        for (size, p), found in totals.items():
            entry, dimension = np.nonzero(found)
            fixed = [np.full(len(entry), v, dtype=np.int32) for v in (size, p)]
            columns = [*fixed, entry.astype(np.int32), dimension.astype(np.int32) - 1, found[entry, dimension]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["size", "part", "entry", "dimension", "total"])

    return run


def _codes(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    digests = {size: digest(of_size) for size, of_size in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, rows, vectors in _stretches(batches):
            codes, errors = np.zeros((len(vectors), PARTS), dtype=np.uint8), np.zeros(len(vectors), dtype=np.int64)
            for p, _, found, far, leaf in _assigned(vectors, books[size]):
                codes[:, p] = found[leaf]
                errors += far[leaf]
            out = pa.table(
                {
                    "vec_id": rows.column("vec_id"), "label": rows.column("label"), "code": pa.array([c.tobytes().hex() for c in codes], pa.string()),
                    "error": errors, "codebooks_sha256": pa.array([digests[size]] * len(codes), pa.string()),
                }
            )
            yield from out.to_batches()

    return run


def digest(books: Sequence[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.reshape(-1).tolist()).encode()).hexdigest()


def kept(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and embedding (doubles) of the rows whose vector is whole and finite."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("embedding").isNotNull() & finite)


def learned(vectors: DataFrame, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks for each length of vectors."""
    books: Codebooks = {}
    sized = vectors.select("vec_id", "embedding", F.size("embedding").alias("size"))
    for (size,) in sorted(sized.select("size").distinct().collect()):
        first = sized.where(F.col("size") == size).orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).collect()
        whole = whole_numbers(np.array([r["embedding"] for r in first], dtype=np.float64).reshape(len(first), size))
        cuts = edges_of(size)
        books[size] = [whole[:, cuts[p] : cuts[p + 1]] for p in range(PARTS)]
    for _ in range(rounds if books else 0):
        sums = vectors.select("embedding").mapInArrow(_sums(books), "size int, part int, entry int, dimension int, total long")
        sums = sums.groupBy("size", "part", "entry", "dimension").agg(F.sum("total").alias("total"))
        found = {size: [np.zeros((len(b), b.shape[1] + 1), dtype=np.int64) for b in of_size] for size, of_size in books.items()}
        for size, p, entry, dimension, total in sums.collect():  # at most 1024 rows for each dimension, and 1024
            found[size][p][entry, dimension + 1] = total
        for size, of_size in books.items():
            for p, book in enumerate(of_size):
                n = found[size][p][:, :1]
                of_size[p] = np.where(n > 0, found[size][p][:, 1:] // np.maximum(n, 1), book)
    return books


def compressed(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    vectors = kept(embeddings)
    label = vectors.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, code string, error long, codebooks_sha256 string"
    rows = written(vectors.mapInArrow(_codes(learned(vectors)), schema), "codes")
    totals = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    return looked_up(rows, totals, ["label"]).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """The rounds one after the other, for vectors of one length that four divides."""
    assigned = """far_{r} AS (
  SELECT p.vec_id, p.part, b.entry, sum((p.v - b.v) * (p.v - b.v))::BIGINT AS far
  FROM parts p JOIN book_{r} b ON p.part = b.part AND p.dimension = b.dimension GROUP BY ALL
), near_{r} AS (
  SELECT vec_id, part, entry, far FROM far_{r} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY far, entry) = 1
)"""
    moved = """book_{n} AS (
  SELECT b.part, b.entry, b.dimension, CASE WHEN s.n IS NULL THEN b.v ELSE ((s.total - ((s.total % s.n) + s.n) % s.n) // s.n)::BIGINT END AS v
  FROM book_{r} b LEFT JOIN (
    SELECT a.part, a.entry, p.dimension, sum(p.v) AS total, count(*) AS n
    FROM near_{r} a JOIN parts p ON a.vec_id = p.vec_id AND a.part = p.part GROUP BY ALL
  ) s ON b.part = s.part AND b.entry = s.entry AND b.dimension = s.dimension
)"""
    steps = []
    for r in range(ROUNDS):
        steps += [assigned.format(r=r), moved.format(r=r, n=r + 1)]
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding, len(embedding) // {PARTS} AS width FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), parts AS (
  SELECT vec_id, d // width AS part, d % width AS dimension,
    floor(greatest(-65536, least(65536, embedding[d + 1]::DOUBLE)) * {SCALE})::BIGINT AS v
  FROM kept, unnest(range(len(embedding))) AS t(d)
), book_0 AS (
  SELECT p.part, k.entry, p.dimension, p.v
  FROM parts p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}) k ON p.vec_id = k.vec_id
), {", ".join(steps)}, {assigned.format(r=ROUNDS)}, codes AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM near_{ROUNDS} GROUP BY vec_id
)
SELECT c.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, dimension)) FROM book_{ROUNDS}) AS codebooks_sha256
FROM codes c JOIN kept k ON c.vec_id = k.vec_id
"""


ORACLE = _oracle()
