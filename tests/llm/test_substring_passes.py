from __future__ import annotations

import uuid

import pytest

from fleetlens.llm import substrings as S
from tests.llm.conftest import words


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
def test_texts_are_hashed_once(spark, docs, monkeypatch, tmp_path, broadcast):
    hashed = S._hashed

    def noted(batches):
        def each():
            for batch in batches:
                (tmp_path / uuid.uuid4().hex).write_text(str(batch.num_rows))
                yield batch

        return hashed(each())

    monkeypatch.setattr(S, "_hashed", noted)
    same = " ".join(words(120, 1)) + "."
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = S.without_repeats(docs(*[f"{' '.join(words(60, i))}.\n{same}" for i in range(2, 22)]).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(bool(r.n_removed) for r in got) == 19
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 20
