"""Tables with one folder per day: reading is pruned by day, and old days go by removing their folders.

Nothing is rewritten when days go, so files of the days that stay are not touched. Only names of folders pass
through the driver, one per day.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.scalars import moment
from fleetlens.operators.filters import Moment
from fleetlens.session import folder_names, remove_folder

DAY = "day"
#: Spark's name for rows without a day.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def write_days(df: DataFrame, path: str, ts: str = "timestamp", mode: str = "append") -> None:
    """Append rows to the folders of their days."""
    df.withColumn(DAY, F.to_date(ts)).write.mode(mode).partitionBy(DAY).parquet(path)


def remove_days(spark: SparkSession, path: str, first_kept: date, name: str = DAY) -> list[str]:
    """Removes the folders ``<name>=<day>`` of all days before the first that is kept; their names.

    Rows without a day are as old as any. Done twice, or over after it broke off, it gives the same.
    """
    head = f"{name}="
    gone = [f for f in folder_names(spark, path) if f.startswith(head) and (f == head + NO_DAY or f[len(head) :] < first_kept.isoformat())]
    for folder in gone:
        remove_folder(spark, f"{path}/{folder}")
    return sorted(gone)


def since(df: DataFrame, start: Moment, ts: str = "timestamp") -> DataFrame:
    """Rows from a moment on; only the folders from its day on are read."""
    return df.where((F.col(DAY) >= F.to_date(moment(start))) & (F.col(ts) >= moment(start)))
