"""Pending, firing and resolved alerts as keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlens.schemas import EVAL_STEP

OUTPUT = "series STRING, ts TIMESTAMP, since TIMESTAMP, state STRING"


class HoldState(StatefulProcessor):
    """State per series: start of the run, last true evaluation, whether it has fired.

    A run ends at the first evaluation that is missing: when a later one comes, or when the watermark
    passes its time (an event-time timer). A run that has fired is then resolved.

    Input rows are true evaluations, at most one per series and step, so a micro-batch holds no
    more rows of a series than evaluations.
    """

    def __init__(self, for_seconds: int, step: int = EVAL_STEP) -> None:
        self.for_seconds = for_seconds
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "since BIGINT, last BIGINT, fired BOOLEAN")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        since, last, fired = self.run.get() if self.run.exists() else (None, None, False)
        before = last
        times = sorted(int(t) for pdf in rows for t in pdf["epoch"])
        out = []
        for t in times:
            if last is not None and t - last != self.step:
                if fired:
                    out.append((key[0], last + self.step, since, "resolved"))
                since, fired = None, False
            since = t if since is None else since
            fired = t - since >= self.for_seconds
            out.append((key[0], t, since, "firing" if fired else "pending"))
            last = t
        if last is not None:
            self.run.update((since, last, fired))
            if before != last:
                if before is not None:
                    self.handle.deleteTimer((before + self.step) * 1000)
                self.handle.registerTimer((last + self.step) * 1000)
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        since, last, fired = self.run.get() if self.run.exists() else (None, None, False)
        out = []
        if last is not None and expiredTimerInfo.getExpiryTimeInMs() == (last + self.step) * 1000:
            if fired:
                out.append((key[0], last + self.step, since, "resolved"))
            self.run.clear()
        yield self._frame(out)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["series", "ts", "since", "state"])
        for c in ("ts", "since"):
            frame[c] = pd.to_datetime(frame[c], unit="s")
        return frame

    def close(self) -> None:
        pass


def hold_stream(conditions: DataFrame, for_seconds: int, step: int = EVAL_STEP, late: int | None = None) -> DataFrame:
    """``conditions``: series STRING, epoch BIGINT (seconds), one row per true evaluation, in time order
    over micro-batches; they may lag behind each other by ``late`` seconds, one step if not given, and rows
    later than that are left out. The session must use the RocksDB state store (``session.ROCKSDB``)."""
    timed = conditions.withColumn("at", F.timestamp_seconds("epoch")).withWatermark("at", f"{step if late is None else late} seconds")
    return timed.groupBy("series").transformWithStateInPandas(
        statefulProcessor=HoldState(for_seconds, step),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="EventTime",
    )
