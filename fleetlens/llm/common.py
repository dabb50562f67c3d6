"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.session import fresh_folder, remove_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words between blanks, tabs and line ends.
PLAIN_WORD = r"[^\x20\x09-\x0D]+"
COPY = "_copy"
CHUNK_ROWS = 10_000
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, UPPER, LOWER)


#: Folders of tables written so far, for ``scratch``.
_folders: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends there, and lost executors cost nothing."""
    path = fresh_folder(df.sparkSession, name)
    _folders.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside are removed at its end; results that read them must be written by then."""
    before = len(_folders)
    try:
        yield
    finally:
        while len(_folders) > before:
            remove_folder(spark, _folders.pop())


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front if the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """The rows as one column ``row`` beside columns of our own, so that no names clash; see ``unpacked``."""
    return df.select(F.struct(*all_columns(df)).alias("row"), *[c.alias(name) for name, c in more.items()])


def unpacked(df: DataFrame, columns: Sequence[str], **changed: Column) -> DataFrame:
    """The columns out of ``row``, with some of them changed."""
    return df.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in columns])


def all_columns(df: DataFrame) -> list[Column]:
    return [df[f"`{c}`"] for c in df.columns]


def row_keys(df: DataFrame) -> tuple[Column, Column]:
    """128 bits that stand for all values of a row. Spark's hash passes over nulls, so these are named."""
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in all_columns(df)])
    return F.xxhash64(*all_columns(df), nulls), F.xxhash64(F.lit(1), *all_columns(df), nulls)


def expand_copies(groups: DataFrame, count: str) -> DataFrame:
    """One row per copy, numbered from 0 in ``_copy``. A group of any size is spread over tasks in chunks."""
    chunks = groups.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col(count) - 1) / CHUNK_ROWS).cast("int"))))
    left = F.col(count) - F.col("_chunk") * CHUNK_ROWS
    return (
        chunks.repartition(*[F.col(f"`{c}`") for c in chunks.columns])
        .withColumn(COPY, F.explode(F.sequence(F.lit(0).cast("long"), F.least(left, F.lit(CHUNK_ROWS)) - 1)))
        .withColumn(COPY, F.col(COPY) + F.col("_chunk") * CHUNK_ROWS)
        .drop("_chunk", count)
    )


def tell_copies_apart(df: DataFrame) -> DataFrame:
    """Numbers equal rows from 0 in ``_copy``, without a window over a group of copies."""
    return expand_copies(df.groupBy(*all_columns(df)).agg(F.count(F.lit(1)).alias("_n")), "_n")


def running_offsets(totals: DataFrame, keys: Sequence[str], bucket: str, sums: Sequence[str]) -> DataFrame:
    """For each bucket of a key, what the buckets before it sum up to (``<name>_before``).

    ``totals`` has one row per key and bucket, and the number of buckets is fixed.
    """
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        *keys, bucket, *[F.coalesce(F.sum(s).over(before), F.lit(0).cast("long")).alias(f"{s}_before") for s in sums]
    )


def looked_up(rows: DataFrame, found: DataFrame, keys: Sequence[str], salts: int = SALTS) -> DataFrame:
    """The rows with the columns of ``found``, which has one row per key; null keys are keys, rows without a match go.

    A key may own any share of the rows: rows are salted by their values, and ``found`` is copied to the salts that a key
    has rows for. Only narrow rows should come here. ``rows`` are read twice.
    """
    names = [*keys, free_name(rows, "_salt")]
    more = [c for c in found.columns if c not in keys]
    salted = rows.withColumn(names[-1], F.pmod(F.xxhash64(*all_columns(rows)), F.lit(salts)))
    used = salted.select(*[F.col(k).alias(f"_used{i}") for i, k in enumerate(names)]).distinct()
    found = found.select(*[F.col(k).alias(f"_found{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_more{i}") for i, c in enumerate(more)])
    copies = used.join(found, reduce(and_, [F.col(f"_used{i}").eqNullSafe(F.col(f"_found{i}")) for i in range(len(keys))]))
    joined = salted.join(copies, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_used{i}")) for i, k in enumerate(names)]))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"_more{i}").alias(c) for i, c in enumerate(more)])
