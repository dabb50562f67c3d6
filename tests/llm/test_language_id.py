from __future__ import annotations

import zlib

import pytest

from fleetlens.llm import language_id as L


@pytest.fixture
def corpus(docs):
    en = "the house of the king and that which is with them on".split()
    de = "das haus der straße und nicht die königin mit ihnen auf ein".split()
    rows = [(i, " ".join((en if i % 2 else de)[(i + k) % 9] for k in range(12)), "en" if i % 2 else "de", "s") for i in range(100)]
    rows += [(200, None, "en", None), (201, "", None, "s"), (202, "12 !! 34", "en", "s"), (None, "the house", "en", "s")]
    rows += [(300, "Straßenhäuser " * 40_000, None, "s"), (300, "the king", "de", "s"), (300, "the king", "de", "s")]
    return docs(*[(*r, 0.5) for r in rows], extra=", score double")


def test_predicts(corpus):
    got = L.identify(corpus).collect()
    assert len(got) == corpus.count()
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == ("en" if i % 2 else "de") for i in range(100))
    assert {by[i].lang_pred for i in (200, 201, 202)} == {"und"} and by[None].lang_pred == "en"
    assert sorted(r.lang_pred for r in got if r.doc_id == 300) == ["de", "en", "en"]


def test_labels_are_not_read(corpus, docs):
    from pyspark.sql import functions as F

    model = L.fit(corpus)
    masked = corpus.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("q"), "doc_id": F.lit(1).cast("long")})
    one = sorted((r.text or "", r.lang_pred, r.score) for r in L.predict(corpus, model).collect())
    assert one == sorted((r.text or "", r.lang_pred, r.score) for r in L.predict(masked, model).collect())


def test_stage(corpus):
    kept = L.understood(corpus)
    assert kept.columns == corpus.columns
    assert {r.doc_id for r in corpus.collect()} - {r.doc_id for r in kept.collect()} == {200, 201, 202}


def test_one_language(docs):
    df = docs(*[(i, "w1 w2 and so on", "en", "s") for i in range(20)])
    assert {(r.lang_pred, r.score) for r in L.identify(df).collect()} == {("en", 1.0)}
    assert L.understood(df).count() == 20


def test_backs_off():
    s = L.Speaker({"langs": ["a", "b"], "words": {}, "grams": {"x": [0.0, 1.0], "^": [0.0, 0.0], "yz": [3.0, 0.0]}})
    assert s.backoff("xq") == [0.0, 1.0] and s.backoff("yz") == [3.0, 0.0]


def test_nothing_learned(docs):
    assert [r.lang_pred for r in L.identify(docs((1, "abc", None, None))).collect()] == ["und"]
    assert L.identify(docs()).count() == 0


def test_held_out_accuracy(spark):
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("driver tables are not here")
    df = spark.read.parquet(path)
    got = L.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
