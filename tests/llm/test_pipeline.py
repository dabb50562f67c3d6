from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from fleetlens.llm import decontaminate, jaccard, mixing
from tests.llm.conftest import words


@pytest.fixture
def folder(spark, docs, tmp_path):
    passage = " ".join(words(14, 77))
    rows = [(i, " ".join(words(40 + i % 30, i)), "en", "abc"[i % 3]) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "a") for i in range(8)]
    rows += [(200, f"{rows[50][1]} more", "en", "b"), (201, f"x {passage} y", "en", "a"), (202, "12 34", "en", "a"), (203, None, "en", "a"), (204, "", None, None)]
    docs(*[(*r, 7) for r in rows], extra=", size int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_each_stage_on_its_own_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "sharding":
            assert out.columns == columns, name
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs.collect()
    ids = {name: Counter(r.doc_id for r in rows) for name, rows in kept.items()}
    assert set(ids["language_id"]) == {*range(60), *range(100, 108), 200, 201}
    assert set(ids["ngram_jaccard"]) == {*range(60), 201} and max(ids["ngram_jaccard"].values()) == 1
    assert set(ids["decontamination"]) == set(range(60))
    sizes = Counter()
    for r in kept["decontamination"]:
        sizes[r.source] += len(r.text.split())
    owed = dict(zip(sorted(sizes), mixing.targets([sizes[s] for s in sorted(sizes)], [5, 2, 1]), strict=True))
    taken = Counter()
    for r in kept["mixing"]:
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - owed[s]) <= 0.5 for s in owed)
    shards = Counter(r.shard for r in kept["sharding"])
    assert sum(shards.values()) == len(kept["mixing"]) and max(shards.values()) - min(shards.values()) <= 1
    assert Counter((r.doc_id, r.text) for r in kept["sharding"]) == Counter((r.doc_id, r.text) for r in kept["mixing"])


def test_run_equals_its_stages(spark, folder):
    once = sorted(map(str, corpus_pipeline.run(spark, folder).collect()))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = decontaminate.clean(jaccard.deduplicated(corpus_pipeline.language(spark, docs, folder)), spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert once == sorted(map(str, corpus_pipeline.shards(spark, mixing.mixed_documents(docs), folder).collect()))


def test_empty(spark, docs, tmp_path):
    docs().write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
