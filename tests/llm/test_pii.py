from __future__ import annotations

import hashlib
import random
import re

import pytest

from fleetlens.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text) if valid(k, m[0])]


ANCHORS = pii.automaton()


def base_of(text):
    return [f"{k}:{a}:{b}" for k, a, b in pii.find(text, ANCHORS) if k in BASE]


@pytest.mark.parametrize(
    "text",
    [
        "a@b.c@d.e a@b.c.d@e.f x..@y.z %@-.-", "1.2.3.4.5.6.7.8.9 256.1.1.1 01.002.0003.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112",
        "+1 (555) 010-9999 +12+3456789012 ++1234567890 +1 +1- +1 2", "é@é.é ü@x.yz é1.1.1.1é", "@", "", "1 2 3  4 5", "http://u:p@h.com/?a@b.c", "9" * 5000,
        "+" * 400, "1." * 500, "a@" * 300, "1-" * 300,
    ],
)
def test_like_the_patterns(text):
    assert base_of(text) == brute(text)


def test_random_texts():
    draw = random.Random(5)
    for _ in range(4000):
        text = "".join(draw.choices("12 5+.-@aé()z", k=draw.randrange(60)))
        assert base_of(text) == brute(text), text
    for _ in range(300):
        number = "".join(draw.choices("0123456789", k=15))
        number = next(number + c for c in "0123456789" if luhn(number + c))
        text = f"x {number[:4]} {number[4:8]}-{number[8:]} {draw.randrange(300)}.1.1.{draw.randrange(300)}"
        assert base_of(text) == brute(text)


def test_added_kinds():
    spans = pii.find("IBAN: DE89 3704 0044 0532 0130 00, ftp://bob:secret@host.org/x IBAN DE00370400440532013000", ANCHORS)
    assert [s for s in spans if s[0] in pii.ADDED_KINDS] == [("iban", 6, 33), ("login", 41, 51)]


def test_rows(docs):
    rows = ["mail a@b.cd now", None, "", (1, "x", "en", "a"), (1, "x", "en", "a"), (None, "1.1.1.1", None, None), "z " * 60_000 + "é 8.8.8.8"]
    got = pii.personal_data(docs(*[(*((i, r, "en", "a") if not isinstance(r, tuple) else r), 5) for i, r in enumerate(rows)], extra=", spans int")).collect()
    assert len(got) == len(rows)
    assert sum(r.n_email for r in got) == 1 and sum(r.n_ip for r in got) == 2
    empty = hashlib.sha256(b"").hexdigest()
    assert sum(r.base_sha256 == empty and r.spans == "" for r in got) == 4
    assert pii.personal_data(docs()).count() == 0
