"""Substring dedup by sliding sentence spans.

A text is cut into sentences (at full stops, question and exclamation marks before a blank, at those of
scripts without blanks, and at line ends). Inside a sentence the cuts are chosen by content: of every
``WINDOW`` words in a row, the sentence is cut after the one with the least hash, the last of equals. So a
passage gets the same cuts wherever it stands, but for fewer than ``WINDOW`` words at its ends, and every
repeated passage of ``2 * WINDOW + WORDS - 1`` (50) words or more holds a run that is found. One word over and
over has no such place and is cut after every ``LONGEST``, so that 75 words of it are needed. A word is what
stands between blanks; in scripts without blanks it is a character, and a word of more than ``LONG_WORD``
characters is read as several, cut the same way by its characters.

From every such part on, the shortest run of at least ``SENTENCES`` consecutive parts with ``WORDS`` words or
more is hashed, and for every part the shortest such run that ends with it: together they cover every longer
run, so that hashing all runs would remove no more. Runs are joined over all documents by a 128-bit hash of
their words. The first place of a run (smallest id, then place) stays; every part that
another place of a repeated run covers is removed. Runs shorter than that, single repeated lines for
instance, are left alone.

A run that many documents hold costs one row per place: places are dealt by their hash once, counted and the
first found where they lie, and joined back there. Nothing is paired.

Defined results: null texts stay null, texts without words stay as they are; rows with equal id and text
are one document and give equal rows; an exact copy under another id loses all that its runs cover. Blanks
between words don't matter (line ends do, they close a sentence), case does. ``n_sentences`` and
``n_removed`` count the parts.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import written

SENTENCES = 2
WORDS = 25
LONGEST = 25
WINDOW = 13
LONG_WORD = 250
WINDOW_CHARACTERS = 9
#: Thai, Lao, Tibetan, Myanmar, Khmer, Chinese and Japanese are written without blanks between words.
_RANGES = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_DENSE = "".join(f"{chr(a)}-{chr(b)}" for a, b in _RANGES)
_MARKS = "".join(chr(c) for a, b in _RANGES[:4] for c in range(a, b + 1) if unicodedata.category(chr(c)).startswith("M"))
_STOPS = "。！？｡؟۔।॥"
_SENTENCE = re.compile(rf"[^\s](?:[^.!?\n{_STOPS}]++|[.!?]++(?=[^\s.!?{_STOPS}]))*+[.!?{_STOPS}]*")
_UNSPACED = re.compile(f"[{_DENSE}]")
_WORD = re.compile(rf"[{_DENSE}][{_MARKS}]*|[^\s{_DENSE}]+")


def picked(keys: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Marks the last place of the least key of every window inside a group that holds more than one key."""
    n, out = len(keys), np.zeros(len(keys), dtype=bool)
    if n < window:
        return out
    low, size = (keys.astype(np.uint64) << np.uint64(32)) | np.arange(n - 1, -1, -1, dtype=np.uint64), 1
    while size < window:
        step = min(size, window - size)
        low, size = np.minimum(low[:-step], low[step:]), size + step
    changes = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
    inside = (group[window - 1 :] == group[: n - window + 1]) & (changes[window - 1 :] != changes[: n - window + 1])
    out[n - 1 - (low[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    return out


def _spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of each word."""
    out = []
    for m in _WORD.finditer(text, start, end):
        if m.end() - m.start() <= LONG_WORD:
            out.append(m.span())
            continue
        keys = np.fromiter((zlib.crc32(c.encode()) for c in m[0]), dtype=np.uint32, count=len(m[0]))
        ends = np.flatnonzero(picked(keys, np.zeros(len(keys)), WINDOW_CHARACTERS)) + m.start() + 1
        ends = [*(e for e in ends.tolist() if e < m.end()), m.end()]
        out += zip([m.start(), *ends[:-1]], ends, strict=True)
    return out


def _divided(text: str) -> tuple[list[re.Match], list[int], list[str], list[int]]:
    """Sentences, the number of words up to the end of each, all words, and the number of words up to each cut."""
    spaced = text.isascii() or not _UNSPACED.search(text)
    found, closed, words = list(_SENTENCE.finditer(text)), [], []
    for m in found:
        some = m[0].split()
        if not spaced or (len(m[0]) > LONG_WORD and max(map(len, some)) > LONG_WORD):
            some = [text[a:b] for a, b in _spans(text, *m.span())]
        words += some
        closed.append(len(words))
    if not words:
        return found, closed, words, []
    keys = np.fromiter((zlib.crc32(w.encode()) for w in words), dtype=np.uint32, count=len(words))
    last = np.zeros(len(words), dtype=bool)
    last[np.array(closed) - 1] = True
    ends = np.flatnonzero(picked(keys, np.cumsum(last) - last, WINDOW) | last) + 1
    wide = np.flatnonzero(np.diff(ends, prepend=0) > LONGEST)
    if len(wide):
        more = [np.arange((ends[i - 1] if i else 0) + LONGEST, ends[i], LONGEST) for i in wide]
        ends = np.sort(np.concatenate([ends, *more]))
    return found, closed, words, ends.tolist()


def parts_of(text: str) -> list[list[str]]:
    """The words of each part."""
    _, _, words, ends = _divided(text)
    return [words[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each part."""
    found, closed, words, ends = _divided(text)
    out, at, before = [], 0, 0
    for m, upto in zip(found, closed, strict=True):
        if ends[at] == upto:
            out.append((m.start(), m.end(), words[before:upto]))
            at, before = at + 1, upto
            continue
        places, first = _spans(text, *m.span()), before
        while before < upto:
            end = ends[at]
            out.append((places[before - first][0], places[end - 1 - first][1], words[before:end]))
            at, before = at + 1, end
    return out


def runs(lengths: list[int]) -> list[tuple[int, int]]:
    """The shortest runs from each part and up to each part, as (first, last + 1), from the numbers of their words.

    They cover every run of ``SENTENCES`` parts and ``WORDS`` words or more with runs inside it.
    """
    total = np.concatenate([[0], np.cumsum(lengths)])
    n = len(lengths)
    if n < SENTENCES or total[n] < WORDS:
        return []
    edges = np.arange(n + 1)
    ends = np.maximum(np.searchsorted(total, total[:n] + WORDS), edges[:n] + SENTENCES)
    starts = np.minimum(np.searchsorted(total, total - WORDS, side="right") - 1, edges - SENTENCES)
    out = {(a, b) for a, b in zip(edges[:n].tolist(), ends.tolist(), strict=True) if b <= n}
    out.update((a, b) for a, b in zip(starts.tolist(), edges.tolist(), strict=True) if a >= 0)
    return sorted(out)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ts, first, last, h1, h2 = [], [], [], [], [], []
        for doc_id, t, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "t", "text")), strict=True):
            parts = parts_of(text) if text else []
            digests = [xxhash.xxh3_128_digest(" ".join(words)) for words in parts]
            for a, b in runs([len(words) for words in parts]):
                pair = np.frombuffer(xxhash.xxh3_128_digest(b"".join(digests[a:b])), dtype=np.int64)
                ids.append(doc_id)
                ts.append(t)
                first.append(a)
                last.append(b)
                h1.append(int(pair[0]))
                h2.append(int(pair[1]))
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip((ids, ts, first, last, h1, h2), types, strict=True)], ["doc_id", "t", "first", "last", "h1", "h2"]
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, total, gone, spans = [], [], [], []
        for text, covered in zip(batch.column("text").to_pylist(), batch.column("covered").to_pylist(), strict=True):
            if not covered:
                texts.append(text)
                total.append(len(_divided(text)[3]) if text else 0)
                gone.append(0)
                spans.append([])
                continue
            parts = sentences(text)
            out = np.zeros(len(parts), dtype=bool)
            for span in covered:
                out[span["first"] : span["last"]] = True
            removed = []
            for (start, end, _), bad in zip(parts, out, strict=True):
                if not bad:
                    continue
                # with the blanks behind it
                while end < len(text) and text[end].isspace():
                    end += 1
                if removed and removed[-1][1] == start:
                    removed[-1] = (removed[-1][0], end)
                else:
                    removed.append((start, end))
            kept, at = [], 0
            for start, end in removed:
                kept.append(text[at:start])
                at = end
            texts.append("".join([*kept, text[at:]]).rstrip())
            total.append(len(parts))
            gone.append(int(out.sum()))
            spans.append([{"start": a, "end": b} for a, b in removed])
        arrays = [
            batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), batch.column("first_ids"),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "n_sentences", "n_removed", "removed", "first_ids"])


def without_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, text (without what was said before), n_sentences, n_removed, removed (spans), first_ids.

    ``first_ids`` are the documents that hold the first places of what was removed.
    """
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("t"))
    # dealt by their hashes once: counting and joining back read the same shuffle, which both need in the same columns
    places = rows.mapInArrow(_hashed, "doc_id long, t long, first int, last int, h1 long, h2 long").repartition("h1", "h2")
    seen = places.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "t", "first", "last")).alias("origin")
    )
    again = places.join(seen.where("n > 1"), ["h1", "h2"]).where(
        ~F.struct("doc_id", "t", "first").eqNullSafe(F.struct("origin.doc_id", "origin.t", "origin.first"))
    )
    again = again.groupBy("doc_id", "t").agg(
        F.collect_set(F.struct("first", "last")).alias("covered"), F.sort_array(F.collect_set("origin.doc_id")).alias("first_ids")
    )
    again = written(again.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "covered", "first_ids"), "repeats")
    joined = rows.join(again, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left")
    return joined.select("doc_id", "text", "covered", "first_ids").mapInArrow(
        _cut, "doc_id long, text string, n_sentences long, n_removed long, removed array<struct<start: long, end: long>>, first_ids array<long>"
    )
