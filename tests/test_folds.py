"""Keyed folds and log timers: a key's rows in order, at the cost of its rows."""

from types import SimpleNamespace

import numpy as np
import pandas as pd

from corpusloom.streaming import logs, streams


def test_rows_of_a_key_in_order():
    a = pd.DataFrame({"k": ["y", "x"], "n": [2, 2], "v": [1.5, None], "t": pd.to_datetime(["2024-01-02", "2024-01-01"])})
    b = pd.DataFrame({"k": ["x"], "n": [1], "v": [3.0], "t": pd.to_datetime(["2024-01-03"])})
    k, n, v, t = streams._in_order(iter([a, b]), ["k", "n", "v", "t"], ["n", "k"])
    assert k == ["x", "x", "y"] and n == [1, 2, 2] and v[0] == 3.0 and np.isnan(v[1]) and v[2] == 1.5
    assert t == list(pd.to_datetime(["2024-01-03", "2024-01-01", "2024-01-02"]))
    assert streams._in_order(iter([a, b]), ["v", "n"], ["n"])[1] == [1, 2, 2]


class Handle:
    """A state store with timers that can't be listed: the state says which one waits."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda x: setattr(self, "value", x))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_a_run_has_one_timer():
    p, handle = logs.LogProgress(5_000_000), Handle()
    p.init(handle)
    line = lambda s, i: SimpleNamespace(micros=s * 1_000_000, event_id=i, line=f"Iter {i}: took 1 s")
    told = [r.kind for r in p.handleInputRows((1,), iter([line(3, 2), line(1, 1)]), None)]
    assert told == ["progress"] * 2 and handle.timers == {8000}
    assert [r.kind for r in p.handleInputRows((1,), iter([line(4, 3)]), None)] == ["progress"] and handle.timers == {9000}
    handle.timers.clear()  # it is due, so the store drops it
    assert [r.micros for r in p.handleExpiredTimer((1,), None, None)] == [9_000_000]
    assert [r.kind for r in p.handleInputRows((1,), iter([line(30, 4), line(40, 5)]), None)] == ["progress", "silent", "progress"] and handle.timers == {45_000}
