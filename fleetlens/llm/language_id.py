"""Language ID by words first, backing off to shorter and shorter character n-grams.

A known word counts by its log frequency in each language. An unknown word is read from left to right by
the longest known n-gram at each place, from four characters down to one; what even these don't know
counts nothing. The language with the largest sum wins; ties go to the smaller name. ``score`` is the share
of the letters, by words, that speak for it; an even share where no word tells the languages apart.

The model is fitted in Spark on a bounded sample: about ``FIT_DOCUMENTS`` different texts of each language,
chosen by a hash of the text, all of them where there are fewer. Copies count once; texts without letters
don't count, and a language that has no others is not learned. From these it keeps at most ``MAX_WORDS``
words and ``MAX_GRAMS`` n-grams per length, the most frequent first, so its size does not grow with the
corpus. Prediction reads every whole text and nothing but the text.

Defined results: ``und`` with score 0 where the text is null or has no letters; where nothing could be
learned, every text is ``und``; every row gives one row, equal rows included; an empty table an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import free_name, written

FIT_DOCUMENTS = 400
MAX_WORDS = 100_000
MAX_GRAMS = 20_000
LONGEST = 4
SMOOTHING = 0.5
FOLDS = 5
LEAST_SCORE = 0.2
UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
CACHED_WORDS = 200_000


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def fit(documents: DataFrame) -> dict:
    """The model: languages, and per word and n-gram the log frequencies by language."""
    labelled = documents.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    digest = F.xxhash64("text")
    # equal texts say nothing more than one of them, and there may be many
    spoken = F.col("text").rlike(r"\p{L}")
    different = labelled.where(spoken).select("lang", digest.alias("h")).distinct()
    sizes = {r["lang"]: r["n"] for r in different.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, FIT_DOCUMENTS / n))).otherwise(share)
    chance = F.pmod(digest, F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = written(labelled.where((chance < share) & spoken).distinct(), "language-sample")
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("gram"))
    words = written(words.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")), "language-words")
    marked = words.select("lang", "n", F.concat(F.lit("^"), "gram", F.lit("$")).alias("w"))

    def pieces_of(k: int) -> DataFrame:
        # a function of one argument: a second one would be the index
        cut = F.transform(F.sequence(F.lit(1), F.char_length("w") - k + 1), lambda i: F.substring(F.col("w"), i, F.lit(k)))
        return marked.where(F.char_length("w") >= k).select("lang", "n", F.lit(k).alias("k"), F.explode(cut).alias("gram"))

    pieces = [pieces_of(k) for k in range(1, LONGEST + 1)]
    grams = pieces[0]
    for piece in pieces[1:]:
        grams = grams.unionByName(piece)
    grams = grams.groupBy("k", "lang", "gram").agg(F.sum("n").alias("n"))
    model: dict = {"langs": langs, "words": {}, "grams": {}}
    if not langs:
        return model
    tables = [(0, words.select("gram", "lang", "n"), MAX_WORDS, 2)] + [(k, grams.where(F.col("k") == k).select("gram", "lang", "n"), MAX_GRAMS, 1) for k in range(1, LONGEST + 1)]
    for k, counts, most, least in tables:
        wide = counts.groupBy("gram").agg(
            F.sum("n").alias("total"), *[F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
        )
        top = wide.where(F.col("total") >= least).orderBy(F.desc("total"), "gram").limit(most).toPandas()
        seen = top[[f"n{i}" for i in range(len(langs))]].to_numpy(dtype=float)
        logs = np.log(seen + SMOOTHING) - np.log(seen.sum(axis=0) + SMOOTHING * (len(seen) + 1))
        target = model["words"] if k == 0 else model["grams"]
        target.update(zip(top["gram"], logs.tolist(), strict=True))
    return model


class Speaker:
    """Sums up the evidence of words; rows of the table are words met so far."""

    def __init__(self, model: dict) -> None:
        self.langs, self.grams, self.known = model["langs"], model["grams"], model["words"]
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs)))
        self.best = np.zeros(1024, dtype=np.int64)

    def backoff(self, word: str) -> list[float]:
        out, marked, i = [0.0] * len(self.langs), f"^{word}$", 0
        while i < len(marked):
            for k in range(min(LONGEST, len(marked) - i), 0, -1):
                if (seen := self.grams.get(marked[i : i + k])) is not None:
                    out = [a + b for a, b in zip(out, seen, strict=True)]
                    break
            i += k
        return out

    def row(self, word: str) -> int:
        at = len(self.rows)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.best = np.concatenate([self.best, np.zeros_like(self.best)])
        seen = self.known.get(word)
        seen = self.backoff(word) if seen is None else seen
        # differences between languages only, so that long words and rare ones don't drown the others
        top = max(seen)
        self.table[at] = [x - top for x in seen]
        self.best[at] = seen.index(top) if min(seen) < top else -1
        self.rows[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not words or not self.langs:
            return UNDETERMINED, 0.0
        if len(self.rows) > CACHED_WORDS:
            self.clear()
        rows = self.rows
        counted = Counter(words)
        at = np.fromiter((rows[w] if w in rows else self.row(w) for w in counted), dtype=np.int64, count=len(counted))
        times = np.fromiter(counted.values(), dtype=np.float64, count=len(counted))
        letters = np.fromiter((len(w) for w in counted), dtype=np.float64, count=len(counted)) * times
        lang = int((self.table[at] * times[:, None]).sum(axis=0).argmax())
        speaking = letters[self.best[at] >= 0].sum()
        score = letters[self.best[at] == lang].sum() / speaking if speaking else 1.0 / len(self.langs)
        return self.langs[lang], float(min(1.0, max(0.0, score)))


def predict(documents: DataFrame, model: dict, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``documents`` with the prediction and its score; columns of these names are replaced."""
    documents = documents.drop(pred, score)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    text_at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speaker = Speaker(shared.value)
        for batch in batches:
            found = [speaker.predict(t) for t in batch.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*batch.schema.names, pred, score],
            )

    schema = T.StructType([*documents.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return documents.mapInArrow(run, schema)


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    model = fit(documents)
    # the id goes along, as a column that the prediction does not read
    found = predict(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def understood(documents: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """Documents whose language is known; undetermined ones and those of mixed speech go."""
    pred, score = free_name(documents, "lang_pred"), free_name(documents, "score")
    found = predict(documents, fit(documents), pred, score)
    return found.where((F.col(pred) != UNDETERMINED) & (F.col(score) >= least_score)).drop(pred, score)
