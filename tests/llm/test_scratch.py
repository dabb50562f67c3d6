from __future__ import annotations

import os

import corpus_pipeline
from fleetlens.llm.common import scratch, written
from fleetlens.session import shared_folder
from tests.llm.conftest import words


def folders(spark):
    root = f"{shared_folder(spark).removeprefix('file:')}/fleetlens"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_tables_go_with_their_block(spark):
    before = folders(spark)
    outside = written(spark.range(3), "outside")
    with scratch(spark):
        written(spark.range(2), "inside")
        assert len(folders(spark) - before) == 2
    assert [f.split("-")[0] for f in folders(spark) - before] == ["outside"] and outside.count() == 3


def test_the_pipeline_leaves_its_last_tables_only(spark, docs, tmp_path):
    docs(*[(i, " ".join(words(60, i)), "en", "ab"[i % 2]) for i in range(30)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some other text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = folders(spark)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 30
    left = {f.rsplit("-", 1)[0] for f in folders(spark) - before}
    assert "pipeline-mixing" in left and not any(f.startswith(("jaccard", "language", "mix-")) for f in left)
    assert not left & {"pipeline-language_id", "pipeline-ngram_jaccard", "pipeline-decontamination"}
