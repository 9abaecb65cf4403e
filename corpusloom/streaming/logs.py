"""Following logs: state for each run, timers for those that fall silent."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the session that runs the stream must have: a state store that keeps timers.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_FIGURES = (("iter", re.compile(r"Iter (\d+)"), int), ("phase", re.compile(r"PHASE (\d+)"), int), ("val_loss", re.compile(r"Val loss ([0-9.]+)"), float))


class LogProgress(StatefulProcessor):
    """A run's latest figures and when it last said anything.

    A line with a figure gives a row of kind progress. A run without a line for ``silent`` microseconds of
    event time gives one of kind silent, dated when the time was up: by its timer, or by the next line where
    that comes in the same batch. The state is a few numbers a run.
    """

    def __init__(self, silent: int):
        self.silent = silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "iter long, phase long, val_loss double, last long, told boolean")

    def _now(self) -> dict:
        if not self.state.exists():
            return {"iter": 0, "phase": 0, "val_loss": None, "last": None, "told": False}
        return dict(zip(("iter", "phase", "val_loss", "last", "told"), self.state.get(), strict=True))

    def _row(self, key, kind: str, micros: int, now: dict) -> Row:
        return Row(run=key[0], kind=kind, micros=micros, iter=now["iter"], phase=now["phase"], val_loss=now["val_loss"])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = self._now()
        if now["last"] is not None and not now["told"]:
            # The one timer that waits: what was last heard says when it is due.
            self.handle.deleteTimer((now["last"] + self.silent) // 1000)
        for r in sorted(rows, key=lambda r: (r.micros, r.event_id)):
            if now["last"] is not None and not now["told"] and r.micros > now["last"] + self.silent:
                yield self._row(key, "silent", now["last"] + self.silent, now)
            found = {name: kind(m[1]) for name, pattern, kind in _FIGURES if (m := pattern.search(r.line or ""))}
            now |= {**found, "last": max(r.micros, now["last"] or r.micros), "told": False}
            if found:
                yield self._row(key, "progress", r.micros, now)
        self.handle.registerTimer((now["last"] + self.silent) // 1000)
        self.state.update(tuple(now.values()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self._now()
        if now["last"] is not None and not now["told"]:
            now["told"] = True
            self.state.update(tuple(now.values()))
            yield self._row(key, "silent", now["last"] + self.silent, now)

    def close(self) -> None:
        pass


def tail(lines: DataFrame, run: str, silent_seconds: int, late: str) -> DataFrame:
    """Follow ``lines`` (``run``, event_id, ts, line): rows of kind progress and silent with the run's
    figures as they stand. Lines later than ``late`` may be dropped by the watermark.

    The session needs ``SETTINGS`` when the stream starts.
    """
    named = lines.withWatermark("ts", late).select(F.col(run).alias("run"), "event_id", F.unix_micros("ts").alias("micros"), "ts", "line")
    kind = named.schema["run"].dataType.simpleString()
    out = f"run {kind}, kind string, micros long, iter long, phase long, val_loss double"
    return named.groupBy("run").transformWithState(LogProgress(silent_seconds * 1_000_000), out, "Append", "EventTime")
