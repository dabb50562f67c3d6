"""What the library must not do, checked on its source."""

from __future__ import annotations

import pathlib
import re

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent / "fleetlens"
FORBIDDEN = {
    "local checkpoints are lost with their executor": r"localCheckpoint",
    "cross joins": r"crossJoin|\.join\([^()]*how=.cross",
    "broadcast hints": r"\bbroadcast\(|hint\(",
    "rows pulled to the driver": r"\.collect\(\)|\.toPandas\(\)|\.toLocalIterator\(|\.take\(|\.head\(",
    "row-at-a-time Python": r"F\.udf|\.rdd\b",
    "windows over everything": r"W\.orderBy|W\.partitionBy\(\)",
    "frames that run to the end from each row": r"rowsBetween\([^)]*unboundedFollowing",
}


@pytest.mark.parametrize("what", list(FORBIDDEN))
def test_not_in_the_library(what):
    found = [
        f"{path.name}: {line.strip()}"
        for path in ROOT.rglob("*.py")
        if "llm" not in path.parts  # it has rules of its own
        for line in path.read_text().splitlines()
        if re.search(FORBIDDEN[what], line)
    ]
    assert not found, what
