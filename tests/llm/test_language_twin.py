"""Fit and prediction of the language model, recomputed in plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import pytest

from fleetlens.llm import language_id as L
from tests.llm.conftest import words

WORD = re.compile(r"[^\W\d_]+")


def fitted(rows):
    """Languages, and the log frequencies of words and of n-grams by language."""
    kept = {(t, lang) for i, t, lang in rows if t and lang and WORD.search(t) and (i is None or zlib.crc32(str(i).encode()) % 5)}
    langs = sorted({lang for _, lang in kept})
    counts = [Counter() for _ in range(L.LONGEST + 1)]
    for text, lang in kept:
        for word in WORD.findall(text.lower()):
            counts[0][word, lang] += 1
            marked = f"^{word}$"
            for k in range(1, L.LONGEST + 1):
                for i in range(len(marked) - k + 1):
                    counts[k][marked[i : i + k], lang] += 1
    tables = []
    for k, seen in enumerate(counts):
        total = Counter()
        for (gram, _), n in seen.items():
            total[gram] += n
        known = [g for g, n in total.items() if n >= (2 if k == 0 else 1)]
        sums = [sum(seen[g, lang] for g in known) for lang in langs]
        tables.append({g: [math.log(seen[g, lang] + 0.5) - math.log(s + 0.5 * (len(known) + 1)) for lang, s in zip(langs, sums, strict=True)] for g in known})
    return langs, tables[0], {g: v for t in tables[1:] for g, v in t.items()}


def evidence(word, langs, known, grams):
    if word in known:
        return known[word]
    marked, out, i = f"^{word}$", [0.0] * len(langs), 0
    while i < len(marked):
        longest = next((k for k in range(min(L.LONGEST, len(marked) - i), 0, -1) if marked[i : i + k] in grams), 0)
        if longest:
            out = [a + b for a, b in zip(out, grams[marked[i : i + longest]], strict=True)]
        i += longest or 1
    return out


def predicted(text, langs, known, grams):
    spoken = WORD.findall(text.lower()) if text else []
    if not spoken or not langs:
        return "und", 0.0
    sums, letters = [0.0] * len(langs), Counter()
    for word in spoken:
        seen = evidence(word, langs, known, grams)
        sums = [a + b - max(seen) for a, b in zip(sums, seen, strict=True)]
        if min(seen) < max(seen):
            letters[seen.index(max(seen))] += len(word)
    lang = sums.index(max(sums))
    return langs[lang], letters[lang] / sum(letters.values()) if letters else 1 / len(langs)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    speech = {"en": "the house of king and that which is with them".split(), "de": "das haus der straße und nicht königin mit ihnen".split(), "fr": "la maison du roi et çelle qui est avec eux".split()}
    out = [(i, " ".join(draw.choices(speech[lang], k=draw.randrange(1, 30))), lang) for i, lang in enumerate(draw.choices(sorted(speech), k=150))]
    out += [(500 + i, " ".join(draw.choices(speech["de"] + speech["en"] + words(3, i, 90) + ["Häuschen", "kingly", "maisonette", "12", "!"], k=8)), None) for i in range(60)]
    return [*out, (900, None, "en"), (901, "", "de"), (902, "12 34", "xx"), (None, "kings", "en"), *[(7, "copy of that", "en")] * 9]


def test_like_plain_python(docs, rows):
    model = fitted(rows)
    got = L.identify(docs(*[(i, t, lang, "s") for i, t, lang in rows])).collect()
    want = Counter((i, *predicted(t, *model)) for i, t, _ in rows)
    rounded = lambda c: sorted(((str(i), lang, round(score, 9)) for i, lang, score in c))
    assert rounded((r.doc_id, r.lang_pred, r.score) for r in got) == rounded(want.elements())
    assert len({lang for _, lang, _ in want}) == 4
