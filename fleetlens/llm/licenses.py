"""License scan: winnowed fingerprints find candidates, banded alignment measures them.

Templates are cut into words (A-Z lower-cased, everything but letters and digits a blank), hashed by runs
of ``GRAM`` words and winnowed: of every ``WINDOW`` neighbouring hashes the smallest is a fingerprint, so any
shared run of GRAM + WINDOW - 1 words shares one. The inverted index from fingerprints to places in
templates is as large as the templates. Each text is winnowed alike; fingerprints found in the index say
where in the text a template could begin. There the template is aligned with the words of the text inside a
band around that diagonal, and reported if enough of its words match in order. Numbers and the words in
``DECISIVE`` tell licenses of one family apart: a match has all those of its template and no other decisive word; in
templates of up to ``SHORT_WORDS`` words no other number either, and words in between count against the
coverage that is asked for. Lines with an SPDX tag must match word for word.

Of matches that share words of the text only the best is reported: most matched words, then most coverage, then
the shorter span, then the smaller name.

Defined results: null and empty texts give no row; the others one row per place where a template occurs, so
equal rows give equal rows; whole texts are read; columns but doc_id and text are not read, whatever their names.
Templates without words are refused.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

GRAM = 3
WINDOW = 2
COVERAGE = 0.8
CACHED_WORDS = 300_000

# Notices, grants and short bodies of common licenses, by their public names.
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published "
        f"by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    )


TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-2.0-notice": _gnu("General Public License", "2"),
    "GPL-3.0-notice": _gnu("General Public License", "3"),
    "LGPL-2.1-notice": _gnu("Lesser General Public License", "2.1"),
    "LGPL-3.0-notice": _gnu("Lesser General Public License", "3"),
    "AGPL-3.0-notice": _gnu("Affero General Public License", "3"),
    "BSD-2-Clause": _BSD_HEAD,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD,
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
}
_COMMONS = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
for _short, _long in _COMMONS.items():
    for _version, _unported in (("3.0", "Unported"), ("4.0", "International")):
        _full = f"This work is licensed under a Creative Commons {_long} {_version} {_unported} License."
        # one of the two forms of a license carries its plain name
        _plain = "CC-BY-NC-4.0" if (_short, _version) == ("BY-NC", "4.0") else None
        TEMPLATES[f"CC-{_short}-{_version}" + ("-notice" if _plain else "")] = _full
        TEMPLATES[_plain or f"CC-{_short}-{_version}-short"] = f"Licensed under CC {_short} {_version}."
#: Names behind an SPDX identifier tag; such a line is the tag and the name, word for word.
_SPDX = (
    "MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Unlicense", "Zlib", "BSL-1.0",
    *(f"CC-{_short}-{_version}" for _short in _COMMONS for _version in ("3.0", "4.0")),
)
TEMPLATES |= {f"{_name}-spdx": f"SPDX-License-Identifier: {_name}." for _name in _SPDX}
#: Words that make another license of one: a match must have them where its template has them, and no others.
DECISIVE = frozenset(
    b"sharealike sa noncommercial nc noderivatives noderivs nd lesser library affero neither endorse mit apache gnu mozilla boost bsd gpl lgpl agpl mpl cc".split()
)
SHORT_WORDS = 20

SCHEMA = "doc_id long, license string, coverage double, matched_words long, template_words long, start long, end long"

_BLANKED = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_SPOKEN = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BLANKED).split()


def fingerprints(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the winnowed hashes of GRAM words; the last smallest of a window counts."""
    n = len(hashes) - GRAM + 1
    if n < 1:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    grams = hashes[:n].copy()
    for i in range(1, GRAM):
        grams = (grams * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[i : i + n]
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    if n < WINDOW:
        at = np.array([n - 1 - int(grams[::-1].argmin())])
        return at, grams[at]
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    at = np.unique(np.arange(len(windows)) + WINDOW - 1 - windows[:, ::-1].argmin(axis=1))
    return at, grams[at]


class Index:
    def __init__(self, templates: dict[str, str]) -> None:
        self.hashes = _Hashes()
        self.words = {name: words_of(text.encode()) for name, text in templates.items()}
        if not all(self.words.values()):
            raise ValueError("a template has no words")
        self.places: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for name, words in self.words.items():
            for at, value in zip(*fingerprints(self.of(words)), strict=True):
                self.places[int(value)].append((name, int(at)))
        self.keys = np.array(sorted(self.places), dtype=np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.hashes.__getitem__, words), dtype=np.uint64, count=len(words))

    def candidates(self, words: list[bytes]) -> list[tuple[str, int]]:
        """(template, place in the text where it would begin), neighbouring diagonals joined."""
        if len(self.hashes) > CACHED_WORDS:
            self.hashes.clear()
        at, values = fingerprints(self.of(words))
        if not len(self.keys):
            return []
        slot = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
        found = np.flatnonzero(self.keys[slot] == values)
        starts: dict[str, list[int]] = defaultdict(list)
        for i in found.tolist():
            for name, place in self.places[int(values[i])]:
                starts[name].append(int(at[i]) - place)
        out = []
        for name, begins in starts.items():
            last = None
            for begin in sorted(begins):
                if last is None or begin - last > band(len(self.words[name])):
                    out.append((name, begin))
                    last = begin
        return out


def band(length: int) -> int:
    return max(2, length // 8)


def align(template: list[bytes], words: list[bytes], begin: int) -> tuple[int, int, int]:
    """Most template words matched in order near the diagonal, and the first and last word of the text used.

    Cell (i, j) is template word i against text word begin + i + j, j within the band. Of equal alignments
    the shorter span wins.
    """
    width = 2 * band(len(template))
    none = (0, 0, 0)  # matches, minus the span's length so far, first place + 1

    def better(a: tuple, b: tuple) -> tuple:
        return a if a[:2] >= b[:2] else b

    row = [none] * (2 * width + 1)
    best, last = none, 0
    for i, word in enumerate(template):
        new = [none] * (2 * width + 1)
        for j in range(2 * width + 1):
            at = begin + i + j - width
            skip = row[j + 1] if j < 2 * width else none  # template word left out
            side = new[j - 1] if j else none  # text word left out
            cell = better(skip, side)
            if 0 <= at < len(words) and words[at] == word:
                seen = row[j]
                first = seen[2] or at + 1
                cell = better((seen[0] + 1, -(at + 1 - first), first), cell)
                if cell[2] and (cell[0], cell[1]) > (best[0], best[1]):
                    best, last = cell, at
            else:
                cell = better(row[j], cell)
            new[j] = cell
        row = new
    return best[0], best[2] - 1, last


def decisive(words: list[bytes]) -> set[bytes]:
    return {w for w in words if w in DECISIVE}


def numbers(words: list[bytes]) -> set[bytes]:
    return {w for w in words if w.isdigit()}


def same_license(template: list[bytes], part: list[bytes], n: int, coverage: float) -> bool:
    """Whether the words a template was aligned with, n of them equal, name the same license."""
    if template[:3] == [b"spdx", b"license", b"identifier"]:
        return part == template
    if decisive(template) != decisive(part) or not numbers(template) <= numbers(part):
        return False
    if len(template) > SHORT_WORDS:
        return n >= coverage * len(template)
    return numbers(template) == numbers(part) and n >= coverage * (len(template) + len(part) - n)


def best_per_place(found: dict[tuple[str, int, int], tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Of (name, first, last) with (matched, template words) those that no better one shares words with."""
    ranked = sorted(found, key=lambda m: (-found[m][0], -found[m][0] / found[m][1], m[2] - m[1], m[0], m[1]))
    taken: list[tuple[int, int]] = []  # disjoint, ascending
    kept = []
    for name, first, last in ranked:
        at = bisect.bisect(taken, (first, last))
        if (at and taken[at - 1][1] >= first) or (at < len(taken) and taken[at][0] <= last):
            continue
        taken.insert(at, (first, last))
        kept.append((name, first, last))
    return kept


def matches(text: bytes, index: Index, coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int, int]]:
    """(license, coverage, matched words, template words, start, end) with code points; ends are exclusive."""
    words = words_of(text)
    found: dict[tuple[str, int, int], tuple[int, int]] = {}
    for name, begin in index.candidates(words):
        template = index.words[name]
        n, first, last = align(template, words, begin)
        if n >= coverage * len(template) and same_license(template, words[first : last + 1], n, coverage):
            found[name, first, last] = max((n, len(template)), found.get((name, first, last), (0, 1)))
    if not found:
        return []
    places = [m.span() for m in _SPOKEN.finditer(text.decode("utf-8", "replace"))]
    out = []
    for place in best_per_place(found):
        (name, a, b), (n, size) = place, found[place]
        out.append((name, n / size, n, size, places[a][0], places[b][1]))
    return sorted(out, key=lambda m: (m[4], m[0], m[5]))


def scan(documents: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, matched_words, template_words, start, end: one row per match."""
    chosen = TEMPLATES if templates is None else templates
    Index(chosen)  # refuses bad templates here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chosen)
        for batch in batches:
            ids, rows = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for match in matches(text, index, coverage) if text else []:
                    ids.append(doc_id)
                    rows.append(match)
            types = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(ids, pa.int64())] + [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "license", "coverage", "matched_words", "template_words", "start", "end"])

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
