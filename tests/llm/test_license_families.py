"""Licenses of one family are told apart, and the index finds what trying every template everywhere finds."""

from __future__ import annotations

import random

import pytest

from fleetlens.llm import licenses as L
from tests.llm.conftest import words

INDEX = L.Index(L.TEMPLATES)


class Everywhere(L.Index):
    """Tries every template at every place."""

    def candidates(self, words):
        return [(name, begin) for name, template in self.words.items() for begin in range(-len(template), len(words))]


def names(text):
    return [m[0] for m in L.matches(text.encode(), INDEX)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", ["CC-BY-NC-ND-4.0"]),
        ("Licensed under CC BY 4.0", ["CC-BY-4.0-short"]),
        ("Licensed under CC BY-SA 4.0", ["CC-BY-SA-4.0-short"]),
        ("Licensed under the Apache License, Version 1.0.", []),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        (L.TEMPLATES["GPL-3.0-notice"].replace("version 3", "version 2"), ["GPL-2.0-notice"]),
        (L.TEMPLATES["BSD-3-Clause"], ["BSD-3-Clause"]),
        ("x SPDX-License-Identifier: BSD-3-Clause y", ["BSD-3-Clause-spdx"]),
        (L.TEMPLATES["Unlicense"], ["Unlicense"]),
        (L.TEMPLATES["BSD-2-Clause"], ["BSD-2-Clause"]),
        ("SPDX-License-Identifier: LGPL-2.0", []),
        ("SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0-spdx"]),
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
        ("Released under the BSD License.", []),
        (L.TEMPLATES["Apache-2.0-notice"], ["Apache-2.0-notice"]),
    ],
)
def test_near_misses(text, want):
    assert names(text) == want
    assert names(" ".join(["before", text, "after", "that"])) == want


@pytest.mark.parametrize("seed", range(6))
def test_like_every_template_at_every_place(seed):
    draw, text = random.Random(seed), words(20, seed)
    for name in draw.sample(sorted(L.TEMPLATES), 6):
        parts = L.TEMPLATES[name].split()
        for _ in range(draw.randrange(3)):
            parts[draw.randrange(len(parts))] = "changed"
        text += [*parts, *words(draw.randrange(30, 60), seed)]
    some = {n: t for n, t in L.TEMPLATES.items() if len(t) < 400}
    text = " ".join(text).encode()
    got = [(m[0], m[2], m[4], m[5]) for m in L.matches(text, L.Index(some))]
    assert got == [(m[0], m[2], m[4], m[5]) for m in L.matches(text, Everywhere(some))]


def test_best_of_a_place():
    found = {("b", 0, 9): (10, 10), ("a", 0, 9): (10, 10), ("c", 5, 30): (9, 9), ("d", 10, 12): (3, 3), ("e", 40, 41): (2, 2)}
    assert sorted(L.best_per_place(found)) == [("a", 0, 9), ("d", 10, 12), ("e", 40, 41)]
