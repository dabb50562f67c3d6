"""Groups of alerts as keyed streaming state: waited for, sent, repeated and resolved (see ``operators.notify``)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlens.operators.notify import flush_of
from fleetlens.schemas import GROUP_INTERVAL, GROUP_WAIT, REPEAT_INTERVAL

OUTPUT = (
    "alertname STRING, since TIMESTAMP, sent_at TIMESTAMP, status STRING, alerts BIGINT, new_alerts BIGINT, resolved_alerts BIGINT, repeat INT"
)


class _Group:
    """A group while changes are applied to it: the alerts they touch are read once and written once."""

    def __init__(self, state: GroupState) -> None:
        self.state = state
        self.began, self.due, self.sent, self.repeats, self.firing = state.clock.get() if state.clock.exists() else (None, None, None, 0, 0)
        self.alerts: dict[str, tuple[bool, bool]] = {}
        self.touched = {alert: started for (alert,), (started,) in state.touched.iterator()}

    def alert(self, alert: str) -> tuple[bool, bool]:
        if alert not in self.alerts:
            stored = self.state.alerts
            self.alerts[alert] = tuple(stored.getValue((alert,))) if stored.containsKey((alert,)) else (False, False)
        return self.alerts[alert]

    def change(self, at: int, alert: str, fires: bool) -> None:
        fired, told = self.alert(alert)
        if fires == fired:
            return
        self.alerts[alert] = (fires, told)
        self.touched[alert] = fires or self.touched.get(alert, False)
        self.began = at if self.began is None else self.began
        self.firing += 1 if fires else -1
        flush = flush_of(at, self.began, self.state.wait, self.state.interval)
        self.due = flush if self.due is None else min(self.due, flush)

    def flush(self, at: int) -> list[tuple]:
        new = gone = short = 0
        for alert, started in self.touched.items():
            fires, told = self.alert(alert)
            new += fires and not told
            gone += told and not fires
            short += started and not told and not fires
            self.alerts[alert] = (fires, fires)
        self.touched = {}
        out = []
        if new or gone or (short and self.firing):
            self.sent, self.repeats = at, 0
            out.append((self.began, at, "firing" if self.firing else "resolved", self.firing, new, gone + short, 0))
        elif self.firing and at - self.sent >= self.state.every:
            self.sent, self.repeats = at, self.repeats + 1
            out.append((self.began, at, "firing", self.firing, 0, 0, self.repeats))
        if self.firing:
            self.due = self.sent + self.state.every
        else:
            self.began = self.due = self.sent = None
        return out

    def keep(self) -> None:
        state = self.state
        for alert, (fires, told) in self.alerts.items():
            if fires or told or alert in self.touched:
                state.alerts.updateValue((alert,), (fires, told))
            elif state.alerts.containsKey((alert,)):
                state.alerts.removeKey((alert,))
        state.touched.clear()
        for alert, started in self.touched.items():
            state.touched.updateValue((alert,), (started,))
        if self.began is None:
            state.clock.clear()
        else:
            state.clock.update((self.began, self.due, self.sent, self.repeats, self.firing))


class GroupState(StatefulProcessor):
    """State per group: its clock, its alerts, those touched since the last flush, and changes still to come.

    A change waits until the watermark passes its time, so changes take effect in order whatever order they come in.
    One event-time timer is set, for the first change or flush to come; when it fires, all up to the watermark is
    done. A flush looks only at the alerts touched since the one before, and only flushes that something waits for, a
    change or a repetition, take place.
    """

    def __init__(self, wait: int = GROUP_WAIT, interval: int = GROUP_INTERVAL, repeat: int = REPEAT_INTERVAL) -> None:
        self.wait, self.interval = wait, interval
        self.every = -(-repeat // interval) * interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "began BIGINT, due BIGINT, sent BIGINT, repeats INT, firing BIGINT")
        self.alerts = handle.getMapState("alerts", "alert STRING", "fires BOOLEAN, told BOOLEAN")
        self.touched = handle.getMapState("touched", "alert STRING", "started BOOLEAN")
        self.coming = handle.getListState("coming", "at BIGINT, alert STRING, fires BOOLEAN")
        self.timer = handle.getValueState("timer", "at BIGINT")

    def _wake(self, at: int) -> None:
        set_for = self.timer.get()[0] if self.timer.exists() else None
        if set_for is None or at < set_for:
            if set_for is not None:
                self.handle.deleteTimer(set_for * 1000)
            self.handle.registerTimer(at * 1000)
            self.timer.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            changes = list(zip(pdf["epoch"].astype(int).tolist(), pdf["alert"].tolist(), pdf["fires"].astype(bool).tolist(), strict=True))
            if not changes:
                continue
            self.coming.appendList(changes)
            self._wake(min(c[0] for c in changes))
        yield self._frame([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        now = timerValues.getCurrentWatermarkInMs() // 1000
        changes = sorted((tuple(c) for c in self.coming.get()), key=lambda c: (c[0], c[2])) if self.coming.exists() else []
        ready = [c for c in changes if c[0] <= now]
        later = changes[len(ready) :]
        if ready:
            self.coming.put(later) if later else self.coming.clear()
        group = _Group(self)
        out = []
        while True:
            due = group.due
            if due is not None and due <= (ready[0][0] if ready else now):
                out += [(key[0], *sent) for sent in group.flush(due)]
            elif ready:
                group.change(*ready.pop(0))
            else:
                break
        group.keep()
        waited = [at for at in (due, later[0][0] if later else None) if at is not None]
        if waited:
            self._wake(min(waited))
        yield self._frame(out)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        names = ["alertname", "since", "sent_at", "status", "alerts", "new_alerts", "resolved_alerts", "repeat"]
        frame = pd.DataFrame(out, columns=names)
        for c in ("since", "sent_at"):
            frame[c] = pd.to_datetime(frame[c], unit="s")
        return frame.astype({"alerts": "int64", "new_alerts": "int64", "resolved_alerts": "int64", "repeat": "int32"})

    def close(self) -> None:
        pass


def notification_stream(changes: DataFrame, late: int, wait: int = GROUP_WAIT, interval: int = GROUP_INTERVAL, repeat: int = REPEAT_INTERVAL) -> DataFrame:
    """``changes``: alertname STRING, alert STRING, epoch BIGINT (seconds), fires BOOLEAN, a row per alert that starts or ends.

    They may come in any order within ``late`` seconds. The session must use the RocksDB state store (``session.prepare``).
    """
    timed = changes.withColumn("at", F.timestamp_seconds("epoch")).withWatermark("at", f"{late} seconds")
    return timed.groupBy("alertname").transformWithStateInPandas(
        statefulProcessor=GroupState(wait, interval, repeat),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="EventTime",
    )
