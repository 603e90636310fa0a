"""Calls of the trend's state for each person and batch."""

import datetime as dt

import pytest
from pyspark.sql import Row

from vitalstrand.streaming.jobs import TrendState


class Handle:
    """State in memory that counts its calls; offers any kind of state by name."""

    def __init__(self):
        self.calls, self.held = 0, None

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls += 1
        self.held = value

    def iterator(self):
        self.calls += 1
        return iter(())

    def updateValue(self, *_):
        self.calls += 1

    def registerTimer(self, *_):
        self.calls += 1

    def getCurrentWatermarkInMs(self):
        return 0


@pytest.mark.parametrize("windows", [1, 40])
def test_calls_do_not_grow_with_windows(windows):
    handle, state = Handle(), TrendState()
    state.init(handle)
    rows = [Row(person_id=1, end_date=dt.date(2024, 1, 1) + dt.timedelta(days=d), prob=d / 100) for d in range(windows)]
    out = list(state.handleInputRows((1,), iter(rows), handle))
    assert len(out) == windows and handle.calls <= 3
