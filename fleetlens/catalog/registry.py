"""Registration of queries and the common form of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.catalog.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}  # as written; their views are put in front once all modules are loaded


def present(df: DataFrame) -> DataFrame:
    """Times as text to the microsecond, doubles to six decimals; NaN and infinity stay what they are.

    Halves at the seventh decimal, as averages of a few two-decimal numbers often are, are rounded away from
    zero even where the last bits of a sum lie below. The twins do the same.
    """
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.DoubleType):
            c = F.round(c + F.signum(c) * F.lit(1e-9), 6)
        columns.append(c.alias(field.name))
    return df.select(*columns)


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(Tables(spark, sf_dir)))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
