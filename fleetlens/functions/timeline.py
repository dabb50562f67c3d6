"""Ordered work over a series that may hold a large share of all rows.

A plain ``Window.partitionBy(series)`` sorts a whole series in one task. Here each series is cut
into time chunks, the window runs inside ``(series, chunk)``, and what a chunk inherits from the
ones before it comes from a table with one row per chunk. Results equal those of the plain window.

A frame that already carries the ``_chunk`` column (see ``chunked``) keeps its partitioning from one
helper to the next, so several of them cost one shuffle of the rows.

Rows without a key belong to the series ``unknown``, rows without a time come first in theirs: the chunk
table is joined back by equality, so ``chunked`` fills both.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A series with a third of 100 TB over a month has some 4 GB in five minutes: one task can sort that.
CHUNK_SECONDS = 300
CHUNK = "_chunk"
BLOCK_ROWS = 10_000


def place(ts: str, tie: str | None = None) -> Column:
    """The order of (time, tie) as one number, for ``max_by`` and ``min_by``.

    A struct as ordering makes Spark sort all rows before it aggregates; a decimal has a fixed size
    and is hash-aggregated. The tie is a whole number such as a row id.
    """
    micros = F.unix_micros(F.col(ts))
    if tie is None:
        return micros
    return micros.cast("decimal(17,0)") * F.lit(Decimal(10**19)) + F.col(tie).cast("decimal(20,0)")


UNKNOWN = "unknown"
TIMELESS = -(2**60)


def known_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Text keys that are null are called ``unknown``."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.nullable}
    return df.withColumns({k: F.coalesce(k, F.lit(UNKNOWN)) for k in keys if k in texts})


def chunked(df: DataFrame, ts: str, seconds: int = CHUNK_SECONDS, keys: Sequence[str] = ()) -> DataFrame:
    """Adds the time chunk of each row, unless it is there; fills the keys."""
    if CHUNK in df.columns:
        return df
    chunk = F.coalesce(F.floor(F.unix_seconds(F.col(ts)) / F.lit(seconds)), F.lit(TIMELESS))
    return known_keys(df, keys).withColumn(CHUNK, chunk)


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null being equal to null."""
    named = {k: f"_key_{k}" for k in keys}
    on = [F.col(k).eqNullSafe(F.col(name)) for k, name in named.items()]
    return left.join(right.withColumnsRenamed(named), on, how).drop(*named.values())


def running(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    aggs: dict[str, tuple[str, Column]],
    seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Running aggregates from the first row of a series up to the current one.

    ``aggs`` maps an output name to ``(kind, column)``; kinds are sum, count, min and max.
    ``order`` starts with ``ts`` and ends with a tie-breaker.
    """
    parts = chunked(df, ts, seconds, keys)
    part = [*keys, CHUNK]
    inside = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)

    local, total, carry, joined = [], [], [], []
    for name, (kind, col) in aggs.items():
        agg = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind]
        merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[kind]
        local.append(agg(col).over(inside).alias(f"_l_{name}"))
        total.append(agg(col).alias(f"_t_{name}"))
        carry.append(merge(F.col(f"_t_{name}")).over(before).alias(f"_c_{name}"))
        here, there = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        both = {"min": F.least, "max": F.greatest}[kind](here, there) if kind in ("min", "max") else here + there
        joined.append(F.coalesce(both, here, there).alias(name))

    inherited = parts.groupBy(*part).agg(*total).select(*part, *carry)
    return parts.select("*", *local).join(inherited, part).select(*df.columns, *joined)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    cols: Sequence[str],
    seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Adds ``prev_<c>``: the value of ``c`` in the row before, null in a series' first row.

    ``order`` is the time and, where times tie, a whole number such as a row id. The last row of each
    chunk comes from a hash aggregate, so the rows themselves are shuffled and sorted once.
    """
    parts = chunked(df, ts, seconds, keys)
    part = [*keys, CHUNK]
    row = F.struct(*[F.col(c) for c in cols])
    # the only chunk without times holds nothing else, and what is last in it is not defined
    lowest = F.lit(TIMELESS) if len(order) == 1 else F.lit(Decimal(-(10**37))) + F.col(order[1]).cast("decimal(20,0)")
    final = F.struct(*[F.max_by(c, F.coalesce(place(*order), lowest)).alias(c) for c in cols])
    before = W.partitionBy(*keys).orderBy(CHUNK)
    inherited = parts.groupBy(*part).agg(final.alias("_final")).select(*part, F.lag("_final").over(before).alias("_carry"))
    return (
        parts.withColumn("_lag", F.lag(row).over(W.partitionBy(*part).orderBy(*order)))
        .join(inherited, part)
        .withColumn("_prev", F.coalesce("_lag", "_carry"))
        .select(*df.columns, *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in cols])
    )


def known_around(
    df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], at: str, seconds: int = CHUNK_SECONDS
) -> DataFrame:
    """Adds ``_p_<c>`` and ``_n_<c>``: the last known value up to a row and the first from it on, as structs (at, v).

    ``at`` is the column that places a value. One row per series and time. Inside a chunk both come from windows; what is known
    before and behind it comes from the chunk table, which is hash-aggregated and has one row per chunk.
    """
    parts = chunked(df, ts, seconds, keys)
    part = [*keys, CHUNK]
    inside = W.partitionBy(*part).rowsBetween(W.unboundedPreceding, W.currentRow)
    chunks = W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    local, edges, carry, joined = [], [], [], []
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col(at).alias("at"), F.col(c).alias("v")))
        micros = F.when(F.col(c).isNotNull(), F.coalesce(F.unix_micros(ts), F.lit(TIMELESS)))
        for name, pick, order in ((f"_p_{c}", F.max_by, lambda x: F.asc(x)), (f"_n_{c}", F.min_by, lambda x: F.desc(x))):
            # looking ahead is looking back in reverse order: a frame to the end would be summed anew for each row
            local.append(F.last(known, ignorenulls=True).over(inside.orderBy(order(ts))).alias(f"_l{name}"))
            edges.append(F.struct(pick(at, micros).alias("at"), pick(c, micros).alias("v")).alias(f"_e{name}"))
            edge = F.when(F.col(f"_e{name}.v").isNotNull(), F.col(f"_e{name}"))
            carry.append(F.last(edge, ignorenulls=True).over(chunks.orderBy(order(CHUNK))).alias(f"_c{name}"))
            joined.append(F.coalesce(f"_l{name}", f"_c{name}").alias(name))
    inherited = parts.groupBy(*part).agg(*edges).select(*part, *carry)
    return parts.select("*", *local).join(inherited, part).select(*df.columns, *joined)


def with_position(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """Row number of each row in its series, from 1."""
    return running(df, keys, ts, order, {name: ("count", F.lit(1))})


def rows_back(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    rows: int,
    cols: Sequence[str],
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds ``back_<c>``: the value of ``c`` that many rows earlier in the series, by row number.

    Series are cut into blocks of equal row counts; the tail of a block is repeated at the head of
    the next, so each block is computed on its own. With running sums this gives sums over the last
    rows at the cost of one lookup.
    """
    if rows > block:
        raise ValueError("a block must hold at least the rows looked back")
    index = F.col(position) - 1
    home = F.floor(index / F.lit(block))
    blocks = F.when(index % block >= block - rows, F.array(home, home + 1)).otherwise(F.array(home))
    spread = df.withColumn("_home", home).withColumn("_block", F.explode(blocks))
    order = W.partitionBy(*keys, "_block").orderBy(position)
    return (
        spread.select("*", *[F.lag(c, rows).over(order).alias(f"back_{c}") for c in cols])
        .where(F.col("_block") == F.col("_home"))
        .drop("_home", "_block")
    )
