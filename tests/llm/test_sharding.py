from __future__ import annotations

import zlib
from collections import Counter

import pytest

from fleetlens.llm import sharding
from fleetlens.llm.sharding import Feistel


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(size):
    f = Feistel(size, 7)
    places = [f.place(i) for i in range(size)]
    assert sorted(places) == list(range(size))
    assert all(f.number(p) == i for i, p in enumerate(places))


def test_column_equals_numbers(spark):
    from pyspark.sql import functions as F

    f = Feistel(1000, 3)
    rows = spark.range(1000).select("id", f.column(F.col("id")).alias("p")).collect()
    assert all(f.place(r.id) == r.p for r in rows)


def check(placed, n, shards):
    counts = Counter(r.shard for r in placed)
    assert len(placed) == n and all(counts[s] in (n // shards, -(-n // shards)) for s in range(shards))
    for s in range(shards):
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(counts[s]))


def test_documents(docs):
    rows = [*[f"text {i}" for i in range(50)], None, "", *[(7, "same", "en", "a")] * 30, (None, "x", None, None), "é" * 50_000]
    placed = sharding.shard_documents(docs(*rows), 8).collect()
    check(placed, len(rows), 8)
    for r in placed:
        if r.size == 5 and r.doc_id == 7:
            assert r.text_crc32 == zlib.crc32(b"same")
        if r.size == 100_001:
            assert r.text_crc32 == zlib.crc32(("é" * 50_000).encode())
    assert [r.size for r in placed if r.text_crc32 is None] == [1]
    again = sharding.shard_documents(docs(*rows).repartition(5), 8).collect()
    assert sorted(map(str, placed)) == sorted(map(str, again))


def test_rows_keep_their_columns(docs, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 4)
    monkeypatch.setattr("fleetlens.llm.common.CHUNK_ROWS", 4)
    rows = [*[(i, f"t{i}", "en", "a", 9, 1) for i in range(11)], *[(5, "hot", None, "b", None, 2)] * 14]
    df = docs(*rows, extra=", shard int, _k1 int")
    placed = sharding.shard(df, 3).collect()
    check(placed, len(rows), 3)
    assert Counter((r.doc_id, r.text, r.lang, r._k1) for r in placed) == Counter((r[0], r[1], r[2], r[5]) for r in rows)


def test_empty(docs):
    assert sharding.shard(docs(), 8).count() == 0
    assert sharding.shard_documents(docs(), 8).count() == 0
