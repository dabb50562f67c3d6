"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is ten consecutive words of a benchmark item (a shorter item is one window). All shingles of a
window must occur for the window to occur, so under an order of shingles by rarity its prefix is one
shingle: the rarest. The steps are

1. shingles of the documents that are shingles of any item, with the words around them: one pass over the
   texts against the table of item shingles;
2. how often each of these occurs in the corpus, and per window the rarest one, its prefix;
3. matches of prefixes are joined to their windows, placed by the position of the shingle in the window;
   length and position decide whether the window fits into the document;
4. the words at that place are compared with the window's: exact containment.

The table of item shingles is sent to all tasks if it has at most ``BROADCAST_SHINGLES`` rows (counted
first); beyond, both sides are shuffled by shingle. A passage that many documents hold gives one row per
place, never pairs of documents.

Defined results: null texts have no words; items without words have no windows; windows that several items
share count for each; equal document rows give equal result rows; ids may be null and are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import ascii_lower, packed, unpacked, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 5
#: 16 to 40 bytes each: some 30 MB at most.
BROADCAST_SHINGLES = 500_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _hash(array: str, at: Column, width: int) -> Column:
    """Hash of ``width`` words from 0-based position ``at``."""
    return F.xxhash64(F.lit(width), *[F.get(F.col(array), at + i) for i in range(width)])


def windows(benchmark: DataFrame) -> DataFrame:
    """window (text), length, start of each shingle in it (at), its width and hash; no items yet."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(WINDOW))
    cut = items.select("item_id", length.alias("length"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))).alias("w"))
    return cut.withColumn("window", F.array_join("w", " "))


def occurrences(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Places where windows occur: row (of ``documents``), start (0-based word), length, item_id.

    ``documents`` has row, w (its words) and n (their number).
    """
    cut = written(windows(benchmark), "windows")
    distinct = cut.select("window", "length", "w").distinct().withColumn("width", F.least("length", F.lit(SHINGLE)))
    parts = distinct.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("width"))))
    widths = [r["width"] for r in parts.select("width").distinct().collect()]  # 1 to SHINGLE
    hashes = F.lit(None).cast("long")
    for width in widths:
        hashes = F.when(F.col("width") == width, _hash("w", F.col("at"), width)).otherwise(hashes)
    parts = written(parts.select("window", "length", "at", hashes.alias("shingle")), "window-shingles")

    known = parts.select("shingle").distinct()
    n_known = known.count()
    if n_known <= BROADCAST_SHINGLES:
        known = F.broadcast(known)
    # a place with the words of every window that could hold the shingle there
    reach = WINDOW - 1
    places = None
    for width in widths:
        at = documents.where(F.col("n") >= width).select("row", "w", "n", F.explode(F.sequence(F.lit(0), F.col("n") - width)).alias("pos"))
        at = at.withColumn("shingle", _hash("w", F.col("pos"), width)).join(known, "shingle")
        first = F.greatest(F.lit(0), F.col("pos") - reach)
        at = at.select("row", "n", "pos", "shingle", first.alias("first"), F.slice("w", first + 1, F.lit(2 * reach + 1)).alias("around"))
        places = at if places is None else places.unionByName(at)
    if places is None:
        schema = documents.select("row", F.lit(0).alias("start"), F.lit(0).alias("length")).where("false")
        return schema.join(benchmark.select("item_id"), F.lit(False))
    places = written(places, "shingle-places")

    seen = places.groupBy("shingle").agg(F.count(F.lit(1)).alias("seen"))
    order = F.struct(F.coalesce("seen", F.lit(0).cast("long")), "at")
    prefix = parts.join(seen, "shingle", "left").groupBy("window", "length").agg(F.min_by(F.struct("shingle", "at"), order).alias("p"))
    prefix = prefix.select("window", "length", "p.shingle", "p.at")
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("length") <= F.col("n"))
    same = F.array_join(F.slice("around", start - F.col("first") + 1, F.col("length")), " ") == F.col("window")
    found = places.join(prefix, "shingle").where(fits).where(same).select("row", start.alias("start"), "length", "window")
    return found.join(cut.select("window", "item_id").distinct(), "window").select("row", "start", "length", "item_id")


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and t (a hash of the text) per document."""
    t = F.xxhash64("text")
    row = F.struct("doc_id", t.alias("t"))
    texts = documents.select(row.alias("row"), words(F.col("text")).alias("w"))
    found = written(occurrences(texts.withColumn("n", F.size("w")), benchmark).distinct(), "occurrences")
    # a word of several windows is hit once
    spans = found.select("row", "start", "length").distinct()
    hit = spans.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("word")).distinct()
    hit = hit.groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    # as many as there are items at most
    items = found.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    result = hit.join(items, "row").select(
        F.col("row.doc_id").alias("_id"), F.col("row.t").alias("_t"), "n_hit", "items"
    )
    sizes = texts.select("row.doc_id", "row.t", F.size("w").cast("long").alias("n_words"))
    joined = sizes.join(result, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"), "t",
    )


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    bad = contamination(documents, benchmark).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).distinct()
    rows = packed(documents, id=F.col("doc_id"), t=F.xxhash64("text"))
    good = rows.join(bad, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left_anti")
    return unpacked(good, documents.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), lengths AS (
  SELECT DISTINCT least(len(w), 10) AS n FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS passage
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0
), places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS passage FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n
), found AS (
  SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, passage)
), hit AS (
  SELECT doc_id, count(DISTINCT k)::BIGINT AS n_hit FROM found, unnest(range(i, i + n)) AS t(k) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
