"""Sharding: a keyed permutation of global row numbers gives each row its shard and slot.

The permutation is a Feistel network over the smallest power-of-two domain that holds all row numbers,
walked until the value lies below their count. Shard and slot can be computed for any row number alone,
in either direction, without moving data.

Defined results: an empty table gives an empty one. Nulls, empty texts and extra columns take part like
other values. Equal rows are told apart by a copy number, so that each copy gets a place of its own;
which of them gets which makes no difference. Columns named like the results are replaced.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm.common import CHUNK_ROWS, COPY, all_columns, packed, row_keys, running_offsets, tell_copies_apart

ROUNDS = 8
#: The domain is less than twice the row count, so a walk longer than this has a chance of 2^-128.
WALK = 128
BUCKETS = 8192
MASK32 = (1 << 32) - 1
MIX_1, MIX_2 = 0x5BD1E995, 0x2C1B3C6D


class Feistel:
    """A permutation of 0 .. size-1, as plain numbers and as a column expression."""

    def __init__(self, size: int, seed: int = 42) -> None:
        self.size = size
        bits = max(2, (max(size, 1) - 1).bit_length())
        self.low = bits // 2
        self.high = bits - self.low
        self.low_mask, self.high_mask = (1 << self.low) - 1, (1 << self.high) - 1
        draw = random.Random(seed)
        self.keys = [draw.getrandbits(31) for _ in range(ROUNDS)]

    @staticmethod
    def _mixed(value: int, key: int) -> int:
        m = ((value ^ key) * MIX_1) & MASK32
        m = ((m ^ (m >> 15)) * MIX_2) & MASK32
        return m ^ (m >> 13)

    def _once(self, value: int) -> int:
        for i, key in enumerate(self.keys):
            if i % 2 == 0:
                value ^= (self._mixed(value & self.low_mask, key) & self.high_mask) << self.low
            else:
                value ^= self._mixed(value >> self.low, key) & self.low_mask
        return value

    def place(self, number: int) -> int:
        value = self._once(number)
        while value >= self.size:
            value = self._once(value)
        return value

    def number(self, place: int) -> int:
        """The row number that has this place."""
        value = place
        while True:
            for i, key in reversed(list(enumerate(self.keys))):
                if i % 2 == 0:
                    value ^= (self._mixed(value & self.low_mask, key) & self.high_mask) << self.low
                else:
                    value ^= self._mixed(value >> self.low, key) & self.low_mask
            if value < self.size:
                return value

    def column(self, number: Column) -> Column:
        def mixed(value: Column, key: Column) -> Column:
            m = (value.bitwiseXOR(key) * F.lit(MIX_1)).bitwiseAND(F.lit(MASK32))
            m = (m.bitwiseXOR(F.shiftright(m, 15)) * F.lit(MIX_2)).bitwiseAND(F.lit(MASK32))
            return m.bitwiseXOR(F.shiftright(m, 13))

        rounds = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(i % 2 == 0).alias("even")) for i, k in enumerate(self.keys)])

        def step(value: Column, r: Column) -> Column:
            to_high = F.shiftleft(mixed(value.bitwiseAND(F.lit(self.low_mask)), r["k"]).bitwiseAND(F.lit(self.high_mask)), self.low)
            to_low = mixed(F.shiftright(value, self.low), r["k"]).bitwiseAND(F.lit(self.low_mask))
            return value.bitwiseXOR(F.when(r["even"], to_high).otherwise(to_low))

        def once(value: Column) -> Column:
            return F.aggregate(rounds, value, step)

        size = F.lit(self.size).cast("long")
        walked = F.aggregate(
            F.sequence(F.lit(1), F.lit(WALK)), once(number.cast("long")), lambda v, _: F.when(v < size, v).otherwise(once(v))
        )
        return F.when(walked < size, walked).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))


def global_numbers(keys: DataFrame, number: str = "row_number") -> DataFrame:
    """Numbers all rows from 0, the same in every run over the same rows; equal rows get ``_copy`` as well.

    The order is that of a hash over all columns and the copy number. Rows are counted per hash bucket, the
    counts are summed up over the (fixed number of) buckets, and rows are numbered inside their bucket.
    """
    rows = tell_copies_apart(keys)
    rows = rows.withColumn("_h", F.xxhash64(*all_columns(rows)))
    rows = rows.withColumn("_bucket", F.pmod(F.col("_h"), F.lit(BUCKETS)).cast("int"))
    totals = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = running_offsets(totals.withColumn("_all", F.lit(0)), ["_all"], "_bucket", ["_rows"]).drop("_all")
    inside = W.partitionBy("_bucket").orderBy("_h", *[F.col(f"`{c}`") for c in keys.columns], COPY)
    return (
        rows.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, "_bucket")
        .withColumn(number, F.col("_rows_before") + F.col("_inside") - 1)
        .drop("_h", "_bucket", "_inside", "_rows_before")
    )


def shard(df: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """Adds ``shard`` (0 .. shards-1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by one row at most; columns ``shard`` and ``slot`` of ``df`` are replaced. Places are worked out on 128-bit keys of the rows; the rows
    themselves are shuffled once, to meet their places. ``df`` is read twice and must give the same rows.
    """
    columns = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    k1, k2 = row_keys(df)
    keyed = packed(df, _k1=k1, _k2=k2)
    keys = keyed.select("_k1", "_k2")
    feistel = Feistel(keys.count(), seed)
    place = feistel.column(F.col("row_number"))
    places = global_numbers(keys).withColumn("_place", place).withColumn("_part", F.floor(F.col(COPY) / CHUNK_ROWS).cast("int"))
    once = keyed.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_n"), F.first("row").alias("row"))
    # a row with very many copies meets them in parts
    few = once.where(F.col("_n") <= CHUNK_ROWS).withColumn("_part", F.lit(0)).join(places, ["_k1", "_k2", "_part"])
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / CHUNK_ROWS).cast("int")))
    many = once.where(F.col("_n") > CHUNK_ROWS).withColumn("_part", parts).join(places, ["_k1", "_k2", "_part"])
    return few.unionByName(many).select(
        *[F.col("row")[c].alias(c) for c in columns],
        F.pmod(F.col("_place"), F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_place") / F.lit(shards)).cast("long").alias("slot"),
    )


def shard_documents(documents: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """The placement of documents, without their texts: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
    )
    placed = shard(rows, shards, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
