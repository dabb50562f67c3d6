"""Mixing sources to target weights by a splitting tree over block quotas.

Texts are cut into blocks of consecutive words; a text shorter than a block is one block. Each source owes
the mix a number of words: passes over all its blocks and, in a last pass, as many blocks in a keyed
permutation as make up the rest (the last of them cut to fit). The numbers of blocks that the sources owe
are split exactly among the output shards: a tree halves the shards, and each half gets a multivariate
hypergeometric share. A shard draws its blocks as disjoint ranges of the permuted blocks of each source and
orders them by a hash of its own, the local shuffle; ties of hashes go by unit, pass and block. ``mixed_blocks`` gives the shards and
their order, ``mixed_sizes`` sums the shards' draws up by document and ``mixed_documents`` puts the drawn blocks together again.

Only totals per source pass through the driver. Sources are configuration-like (the weights name them), and
more than ``MAX_SOURCES`` of them are refused; everything that grows with the rows stays distributed: ranks
in a source come from 4096 hash buckets per source, whose sums are added up, and a count inside the bucket.

Defined results: null and empty texts have no words and no blocks; a null source is a source of its own and
comes last; equal rows are told apart by a copy number; an empty table gives an empty mix; a source without
words has target 0; more than ``MAX_SOURCES`` sources are an error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import COPY, PLAIN_WORD, expand_copies, packed, row_keys, running_offsets, unpacked, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 1024
SHARDS = 8
MAX_SOURCES = 100_000
DEVIATIONS = 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PLAIN_WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[int], share: float = SHARE, most: int = MOST) -> list[float]:
    """Words per source: by weight, none above ``most`` times its size, the excess reshared by weight."""
    total = share * sum(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    capped, free, out = 0, sum(weights), [0.0] * len(sizes)
    for at, i in enumerate(order):
        unit = (total - capped) / free
        if most * sizes[i] > unit * weights[i]:
            for j in order[at:]:
                out[j] = unit * weights[j]
            break
        out[i] = float(most * sizes[i])
        capped += most * sizes[i]
        free -= weights[i]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of ``take`` blocks are good, by inversion: one law for totals of every size.

    Chances are built up from the most likely number by their ratios. Those beyond ``DEVIATIONS`` standard deviations
    sum up to less than a double can tell from nothing, so the table grows with the root of the total only.
    """
    low, high = max(0, take - bad), min(good, take)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (take + 1) * (good + 1) // (total + 2)))
    spread = take * (good / total) * (bad / total) * ((total - take) / max(total - 1, 1))
    reach = int(DEVIATIONS * math.sqrt(spread)) + 50
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)  # the ratio of the chances of k + 1 and k
    logs = np.concatenate([[0.0], np.cumsum(np.log(good - k) + np.log(take - k) - np.log(k + 1) - np.log(bad - take + k + 1))])
    chances = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(chances, rng.random() * chances[-1], side="right"))


def splitting_tree(quotas: Sequence[int], shards: int, seed: int) -> list[list[int]]:
    """For each shard the number of blocks from each source. Shards get equal totals up to one block."""
    rng = np.random.default_rng(seed)

    def split(left_over: list[int], n: int) -> list[list[int]]:
        if n == 1:
            return [left_over]
        total, half = sum(left_over), n // 2
        take, rest, left = total * half // n, total, []
        for quota in left_over:
            rest -= quota
            drawn = _hypergeometric(rng, quota, rest, take) if take else 0
            take -= drawn
            left.append(drawn)
        return split(left, half) + split([q - d for q, d in zip(left_over, left, strict=True)], n - half)

    return split(list(quotas), shards)


def mix(units: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Draws the mix of ``units`` (unit: string, unique; source: string; size: long, words).

    Returns the draws (unit, source, pass, block, words, shard, place), one row per drawn block, ``words`` of
    it from its start, ``place`` the order in its shard; and the sources (source, source_size, target).
    """
    spark = units.sparkSession
    units = written(units, "mix-units")  # the texts are read once
    per_source = (
        units.groupBy("source")
        .agg(F.sum("size").alias("size"), F.sum(F.ceil(F.col("size") / block_words)).alias("blocks"))
        .orderBy(F.col("source").isNull(), "source")
        .limit(MAX_SOURCES + 1)
        .collect()
    )
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(per_source))]
    sizes = [r["size"] for r in per_source]
    owed = targets(sizes, weights)
    passes = [int(t // s) if s else 0 for t, s in zip(owed, sizes, strict=True)]
    rests = [math.floor(t - n * s + 0.5) for t, n, s in zip(owed, passes, sizes, strict=True)]
    sources = spark.createDataFrame(
        [(r["source"], s, t) for r, s, t in zip(per_source, sizes, owed, strict=True)],
        "source string, source_size long, target double",
    )

    blocks = units.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / block_words) - 1).cast("int")))
    )
    blocks = blocks.withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words))
    blocks = blocks.withColumn("key", F.md5(F.concat_ws("/", F.lit(str(seed)), "unit", F.col("block").cast("string"))))
    blocks = blocks.withColumn("bucket", F.substring("key", 1, 3)).drop("size")
    totals = blocks.groupBy("source", "bucket").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n"))
    plan = spark.createDataFrame(
        [(r["source"], n, rest) for r, n, rest in zip(per_source, passes, rests, strict=True)],
        "source string, passes int, rest long",
    )
    offsets = running_offsets(totals, ["source"], "bucket", ["words", "n"])
    offsets = offsets.join(plan, offsets["source"].eqNullSafe(plan["source"])).drop(plan["source"])

    inside = W.partitionBy("source", "bucket").orderBy("key", "unit")
    earlier = inside.rowsBetween(W.unboundedPreceding, -1)
    ranked = blocks.withColumns(
        {"_rank": F.row_number().over(inside) - 1, "_words": F.coalesce(F.sum("words").over(earlier), F.lit(0).cast("long"))}
    )
    ranked = ranked.join(offsets, ranked["source"].eqNullSafe(offsets["source"]) & (ranked["bucket"] == offsets["bucket"])).select(
        "unit", ranked["source"], "block", "words", "key", "passes",
        (F.col("_rank") + F.col("n_before")).alias("rank"),
        F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("rest") - F.col("words_before") - F.col("_words"))).alias("extra"),
    )
    drawn = ranked.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes")))).withColumn(
        "words", F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(F.col("extra"))
    ).where("words > 0")

    extra = {r["source"]: r["n"] for r in ranked.where("extra > 0").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    quotas = [n * r["blocks"] + extra.get(r["source"], 0) for r, n in zip(per_source, passes, strict=True)]
    tree = splitting_tree(quotas, shards, seed)
    ends = np.cumsum(np.array(tree, dtype=np.int64).reshape(shards, -1), axis=0).T.tolist()
    ranges = spark.createDataFrame(
        [(r["source"], r["blocks"], e) for r, e in zip(per_source, ends, strict=True)],
        T.StructType([T.StructField("source", T.StringType()), T.StructField("blocks", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))]),
    )
    turn = F.col("rank") + F.col("pass") * F.col("blocks")
    drawn = drawn.join(ranges, drawn["source"].eqNullSafe(ranges["source"])).select(
        "unit", drawn["source"], "pass", "block", "words",
        F.size(F.filter("ends", lambda end: end <= turn)).alias("shard"),
        F.xxhash64("key", "pass").alias("place"),
    )
    return drawn, sources


def with_units(documents: DataFrame, key: list[str]) -> DataFrame:
    """Documents' keys, sources and sizes with a ``unit`` of their own per row, equal rows included."""
    rows = documents.select(*key, "source", n_words(F.col("text")).alias("size"))
    rows = expand_copies(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")), "_n")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (*key, "size", COPY)]
    return rows.withColumn("unit", F.concat_ws("/", *named, F.coalesce("source", F.lit("null")), F.col("source").isNull().cast("string")))


def mixed_sizes(documents: DataFrame) -> DataFrame:
    """Per document, how many of its words the mix takes, repeats counted, in all and by shard (of those that take any)."""
    units = with_units(documents, ["doc_id"])
    drawn, sources = mix(units)
    by_shard = drawn.groupBy("unit", "shard").agg(F.sum("words").alias("words"))
    taken = by_shard.groupBy("unit").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("by_shard"))
    joined = units.join(taken, "unit", "left")
    return joined.join(sources, joined["source"].eqNullSafe(sources["source"])).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "by_shard"
    )


def mixed_blocks(documents: DataFrame) -> DataFrame:
    """The mix shard by shard, without its texts: a row per drawn block, ``slot`` its place in the shard's order, from 0.

    ``words`` are taken of the block from its start; ``copy`` tells rows with equal doc_id, source and size apart.
    """
    units = with_units(documents, ["doc_id"])
    drawn, _ = mix(units)
    drawn = written(drawn.withColumn("bucket", F.shiftright("place", 52)), "mix-blocks")
    offsets = running_offsets(drawn.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")), ["shard"], "bucket", ["n"])
    inside = W.partitionBy("shard", "bucket").orderBy("place", "unit", "pass", "block")
    placed = drawn.withColumn("_inside", F.row_number().over(inside) - 1).join(offsets, ["shard", "bucket"])
    return placed.join(units.drop("source"), "unit").select(
        "shard", (F.col("n_before") + F.col("_inside")).alias("slot"), "doc_id", "source", "size", F.col(COPY).alias("copy"), "pass", "block", "words"
    )


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The mix as documents: a row per document and pass, its text the drawn blocks in their order.

    A document drawn whole keeps its text as it is; one without words is in no pass and goes.
    """
    k1, k2 = row_keys(documents)
    units = with_units(documents.select(k1.alias("k1"), k2.alias("k2"), "source", "text"), ["k1", "k2"])
    drawn, _ = mix(units)
    picked = drawn.groupBy("unit", "pass").agg(
        F.sort_array(F.collect_list(F.struct("block", "words"))).alias("picked"), F.sum("words").alias("words")
    )
    picked = picked.join(units.select("unit", "k1", "k2", "size"), "unit").drop("unit", "pass")
    rows = packed(documents, k1=k1, k2=k2).dropDuplicates(["k1", "k2"]).join(picked, ["k1", "k2"])
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit(rf"{PLAIN_WORD}[\x20\x09-\x0D]*"), F.lit(0))
    whole = F.col("words") == F.col("size")
    rows = rows.withColumn("pieces", F.when(~whole, pieces))
    parts = F.flatten(F.transform("picked", lambda p: F.slice(F.col("pieces"), p["block"] * BLOCK_WORDS + 1, p["words"].cast("int"))))
    rows = rows.withColumn("text", F.when(whole, F.col("row.text")).otherwise(F.array_join(parts, "")))
    return unpacked(rows, documents.columns, text=F.col("text"), n_chars=F.char_length("text").cast("long"))


#: The same in SQL: the blocks are ranked by the same digests, the sources' targets by the same formula.
ORACLE = r"""
WITH rows_ AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), units AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS copy FROM rows_
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM units GROUP BY source
), weighed AS (
  SELECT *, CASE nth % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS w FROM sources
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, nth) AS o FROM weighed
), units_of AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM weighed)::BIGINT - coalesce(sum(2 * source_size) OVER before, 0)::BIGINT)
    / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER before, 0))::BIGINT AS unit
  FROM ordered WINDOW before AS (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), first_free AS (
  SELECT min_by(unit, o) AS unit, min(o) AS o FROM units_of WHERE 2 * source_size > unit * w
), owed AS (
  SELECT u.source, u.source_size, CASE WHEN u.o >= f.o THEN f.unit * u.w ELSE (2 * u.source_size)::DOUBLE END AS target
  FROM units_of u LEFT JOIN first_free f ON true
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes,
    floor(target - (CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END) * source_size + 0.5)::BIGINT AS rest
  FROM owed
), blocks AS (
  SELECT doc_id, source, size, copy, b AS block, least(1024, size - b * 1024) AS words,
    md5(concat('42/', coalesce(doc_id::VARCHAR, 'null'), '/', size, '/', copy, '/', coalesce(source, 'null'), '/', (source IS NULL)::VARCHAR, '/', b)) AS key
  FROM units, unnest(range((size + 1023) // 1024)) AS t(b)
), ranked AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM blocks
), taken AS (
  SELECT r.doc_id, r.source, r.size, r.copy, sum(greatest(0, least(r.words, p.rest - r.earlier)))::BIGINT AS extra
  FROM ranked r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source GROUP BY ALL
)
SELECT u.doc_id, u.size, p.source_size, p.target, (p.passes * u.size + coalesce(t.extra, 0))::BIGINT AS taken
FROM units u JOIN plan p ON u.source IS NOT DISTINCT FROM p.source
LEFT JOIN taken t ON u.doc_id IS NOT DISTINCT FROM t.doc_id AND u.source IS NOT DISTINCT FROM t.source AND u.size = t.size AND u.copy = t.copy
"""
