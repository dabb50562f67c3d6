from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.llm import language_id as L


def test_copies_and_empty_texts_take_no_share(spark, docs):
    """300 different texts of each language, among 30 000 copies of one, empty ones or ones without letters."""
    def word(kind, i):
        return kind + "".join(chr(ord("a") + int(c)) for c in str(i))

    # a document without id is not held out
    rows = [(None, f"{word(kind, i)} {word(kind, i)}", lang, "s") for kind, lang in (("x", "de"), ("y", "en"), ("z", "fr")) for i in range(300)]
    texts = F.when(F.col("id") % 3 == 0, "x x").when(F.col("id") % 3 == 1, "").otherwise("12 !")
    langs = F.when(F.col("id") % 3 == 0, "de").when(F.col("id") % 3 == 1, "en").otherwise("fr")
    many = spark.range(90_000).select(
        F.lit(None).cast("long").alias("doc_id"), texts.alias("text"), langs.alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars")
    )
    model = L.fit(docs(*rows).unionByName(many))
    assert model["langs"] == ["de", "en", "fr"]
    for kind in "xyz":
        assert sum(w[0] == kind and len(w) > 1 for w in model["words"]) == 300, kind


def test_a_language_without_words_is_not_learned(docs):
    df = docs((None, "12 !!", "fr", "s"), (None, "the king the king", "en", "s"), (None, "", "de", "s"))
    assert L.fit(df)["langs"] == ["en"]
    assert {r.lang_pred for r in L.identify(df.where("text like '%king'")).collect()} == {"en"}
