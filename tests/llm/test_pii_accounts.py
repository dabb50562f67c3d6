from __future__ import annotations

import pytest

from fleetlens.llm import pii

ANCHORS = pii.automaton()
GERMAN, BRITISH, NORWEGIAN = "DE89370400440532013000", "GB82WEST12345698765432", "NO9386011117947"


def found(text):
    return [text[a:b] for kind, a, b in pii.find(text, ANCHORS) if kind == "iban"]


@pytest.mark.parametrize("behind", [" BIC COBADEFF", " 2024", " A1 B2 C3", " Bank", ", 5", "", " IBAN " + NORWEGIAN])
@pytest.mark.parametrize("number", [GERMAN, BRITISH, NORWEGIAN, "DE89 3704 0044 0532 0130 00"])
def test_what_stands_behind(number, behind):
    rest = [NORWEGIAN] if NORWEGIAN in behind else []
    assert found(f"IBAN: {number}{behind}") == [number, *rest]
    assert found(f"to {number}{behind}") == [number, *rest]


def test_wrong_ones():
    assert found("IBAN DE88370400440532013000 BIC X1") == found("DE88370400440532013000") == []
    assert found(f"x{GERMAN}") == found(f"{GERMAN}7") == found(f"{GERMAN}x") == []
    assert found(f"IBAN DE00370400440532013000 IBAN {GERMAN[:4]} {GERMAN[4:]}") == [f"{GERMAN[:4]} {GERMAN[4:]}"]


def test_unknown_country():
    number = next(n for c in range(100) if pii._mod97(n := f"QQ{c:02}12345678901234"))
    assert found(f"IBAN {number} BIC") == [number] and found(f"to {number}") == []
