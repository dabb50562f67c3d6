"""Fill-in-middle: texts are cut into prefix, middle and suffix and put together in another order.

A text is laid into blocks of a fixed number of bytes. A Fenwick tree over the blocks holds how many units and
how many code points begin in each; a descent by halved steps finds the block of a cut, with the code points
before it, and the cut itself is looked for inside that block only. Units are code points, words (with the
blanks after them; those in front of the first belong to it) or lines (with their ends). Two cuts, the form and
whether a text is changed at all are drawn from a digest of seed and doc_id, so reruns agree.

Forms: ``plain`` is the text itself, ``psm`` prefix, suffix, middle and ``spm`` suffix, prefix, middle, each
behind its mark. ``restored`` gives the exact text back.

Defined results: a null text is an empty one; empty texts and texts that hold a mark are plain; a text without
units (blanks only, cut by words) has its two cuts at its start; a null doc_id is drawn for like an empty number;
every row gives one row, equal rows equal ones; whole texts are cut, whatever their length; other columns are not
read, whatever their names. Bytes that are no UTF-8 stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_POINT, WORD, LINE = "code_point", "word", "line"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Marks in front of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = 1
CHANGED_PERCENT = 90
SPM_PERCENT = 20
BLOCK_BYTES = 4096
#: Bytes of output that leave a task at once.
BATCH_BYTES = 8 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


class Fenwick:
    """Sums over leading blocks of two counts, units and code points. Node i holds as many blocks as its lowest set bit says."""

    def __init__(self, units: np.ndarray, chars: np.ndarray) -> None:
        self.top = 1 << max(len(units) - 1, 0).bit_length()
        self.tree = np.zeros((2, self.top + 1), dtype=np.int64)
        self.tree[0, 1 : len(units) + 1] = units
        self.tree[1, 1 : len(chars) + 1] = chars
        step = 1
        while step < self.top:
            self.tree[:, 2 * step :: 2 * step] += self.tree[:, step :: 2 * step]
            step *= 2

    def find(self, unit: int) -> tuple[int, int, int]:
        """The block where this unit (from 0) begins, the units of the block before it, the code points before the block."""
        block, chars, step = 0, 0, self.top
        while step:
            node = block + step
            if node <= self.top and self.tree[0, node] <= unit:
                block = node
                unit -= int(self.tree[0, node])
                chars += int(self.tree[1, node])
            step //= 2
        return block, unit, chars


def _begins(raw: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, whether a unit and whether a code point begins there."""
    chars = (raw & 0xC0) != 0x80
    if unit == CODE_POINT:
        return chars, chars
    if unit == LINE:
        ends = raw == 0x0A
        return np.concatenate([[True], ends[:-1]])[: len(raw)], chars
    blank = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    return ~blank & np.concatenate([[True], blank[:-1]])[: len(raw)], chars


class Cuttable:
    """A text that can be cut after any number of its units."""

    def __init__(self, text: bytes, unit: str = CODE_POINT, block_bytes: int = BLOCK_BYTES) -> None:
        self.size, self.block_bytes = len(text), block_bytes
        self.units, self.chars = _begins(np.frombuffer(text, dtype=np.uint8), unit)
        starts = np.arange(0, self.size, block_bytes)
        counts = [np.add.reduceat(mask, starts, dtype=np.int64) if self.size else np.zeros(0, dtype=np.int64) for mask in (self.units, self.chars)]
        self.n, self.n_chars = (int(c.sum()) for c in counts)
        self.index = Fenwick(*counts)

    def cut(self, n: int) -> tuple[int, int]:
        """Where the first n units end: byte and code point."""
        if n == 0:
            return 0, 0
        if n >= self.n:
            return self.size, self.n_chars
        block, inside, before = self.index.find(n)
        start = block * self.block_bytes
        at = int(np.flatnonzero(self.units[start : start + self.block_bytes])[inside])
        return start + at, before + int(np.count_nonzero(self.chars[start : start + at]))


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def _checked(marks: Sequence[str]) -> tuple[str, str, str]:
    """Marks that can be found again: none may hold another one, or begin with what one ends with."""
    prefix, suffix, middle = marks
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if not a or (i != j and b in a) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"marks {a!r} and {b!r} may run into each other")
    return prefix, suffix, middle


def fill_in_middle(
    documents: DataFrame,
    unit: str = CODE_POINT,
    changed_percent: int = CHANGED_PERCENT,
    spm_percent: int = SPM_PERCENT,
    seed: int = SEED,
    marks: Sequence[str] = MARKS,
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars and middle_chars (code points, null if plain), output (string)."""
    if unit not in (CODE_POINT, WORD, LINE):
        raise ValueError(f"no such unit: {unit}")
    prefix_mark, suffix_mark, middle_mark = (m.encode() for m in _checked(marks))

    def one(doc_id: int | None, text: bytes) -> tuple:
        whole = Cuttable(text, unit)
        h1, h2, h3, h4 = draws(doc_id, seed)
        if not text or h3 % 100 >= changed_percent or prefix_mark in text or suffix_mark in text or middle_mark in text:
            return whole.n, PLAIN, None, None, text
        first, second = sorted((h1 % (whole.n + 1), h2 % (whole.n + 1)))
        (a, prefix_chars), (b, chars) = whole.cut(first), whole.cut(second)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        spm = h4 % 100 < spm_percent
        head = [suffix_mark, suffix, prefix_mark, prefix] if spm else [prefix_mark, prefix, suffix_mark, suffix]
        return whole.n, SPM if spm else PSM, prefix_chars, chars - prefix_chars, b"".join([*head, middle_mark, middle])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                doc_id = doc_id.as_py()
                rows.append((doc_id, *one(doc_id, text.as_py() or b"")))
                size += len(rows[-1][-1])
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(cut, SCHEMA).withColumn("output", F.col("output").cast("string"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text, from output and form alone."""
    prefix, suffix, middle = _checked(marks)
    m = F.instr(output, middle)

    def between(mark: str, begin: Column | int, end: Column) -> Column:
        begin = F.lit(begin) + len(mark)
        return F.substring(output, begin, end - begin)

    s, p = F.instr(output, suffix), F.instr(output, prefix)
    end = F.length(output) + 1
    psm = F.concat(between(prefix, 1, s), between(middle, m, end), between(suffix, s, m))
    spm = F.concat(between(prefix, p, m), between(middle, m, end), between(suffix, 1, p))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def digests(documents: DataFrame) -> DataFrame:
    """What ``fill_in_middle`` makes of the documents, its texts as digests."""
    return fill_in_middle(documents).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT *, ('0x' || h[1:8])::UBIGINT % (n + 1)::UBIGINT AS a, ('0x' || h[9:16])::UBIGINT % (n + 1)::UBIGINT AS b,
    ('0x' || h[17:24])::UBIGINT % 100 AS c, ('0x' || h[25:32])::UBIGINT % 100 AS d
  FROM texts
), cut AS (
  SELECT doc_id, t, n, least(a, b)::BIGINT AS p, greatest(a, b)::BIGINT AS q,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain'
      WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, substr(t, 1, p) AS prefix, substr(t, p + 1, q - p) AS middle, substr(t, q + 1) AS suffix FROM cut
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle)
    ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
