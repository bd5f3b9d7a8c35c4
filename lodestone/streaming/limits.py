"""Rate limits and the circuit breaker as stateful streams.

A counter lives for `ttl` seconds after the last event that it counted; an event that is refused doesn't prolong it. An
event that comes late, but within the watermark, meets the counter as it stands and doesn't turn its time back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.streaming.state import in_order, stored_in_rocks


class Counter:
    """A counter with a time to live, over microseconds of event time."""

    def __init__(self, ttl: int, n: int = 0, last: int = 0):
        self.ttl, self.n, self.last = ttl * 1_000_000, n, last

    def at(self, now: int) -> int:
        if self.n and now - self.last >= self.ttl:
            self.n = 0
        return self.n

    def count(self, now: int) -> None:
        live = self.at(now)
        self.n, self.last = live + 1, max(now, self.last) if live else now

    def reset(self) -> None:
        self.n = 0


class _Counted(StatefulProcessor):
    """A counter for each key in a value of its state, and a timer that drops it once the watermark has passed its life."""

    def __init__(self, key: str, ttl: int, columns: tuple[str, ...], most: int):
        self.key, self.ttl, self.columns, self.most = key, ttl, columns, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("counter", "n int, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counter = Counter(self.ttl, *(self.counter.get() if self.counter.exists() else (0, 0)))
        out = [self.step(counter, key[0], *event) for event in in_order(rows, self.columns, "event_id")]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if counter.n:
            self.counter.update((int(counter.n), int(counter.last)))
            self.handle.registerTimer(max(counter.last // 1000 + self.ttl * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        elif self.counter.exists():
            self.counter.clear()
        yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counter.clear()
        yield from ()

    def close(self) -> None:
        pass


class _Limiter(_Counted):
    def step(self, counter: Counter, own, now: int, event_id) -> dict:
        allowed = counter.at(now) < self.most
        if allowed:
            counter.count(now)
        return {self.key: own, "event_id": event_id, "ts": pd.Timestamp(now, unit="us"), "allowed": allowed, "counted": counter.n}


class _Breaker(_Counted):
    def step(self, counter: Counter, own, now: int, event_id, failed) -> dict:
        if failed:
            counter.count(now)
        else:
            counter.reset()
        return {self.key: own, "event_id": event_id, "ts": pd.Timestamp(now, unit="us"), "failures": counter.n, "open": counter.n >= self.most}


def _stateful(stream: DataFrame, processor: _Counted, schema: str, lateness: str) -> DataFrame:
    stored_in_rocks(stream.sparkSession)
    return stream.withWatermark("ts", lateness).groupBy(processor.key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def rate_limited(stream: DataFrame, key: str, limit: int, ttl: int, lateness: str = "10 minutes") -> DataFrame:
    """(key, event_id, ts, allowed, counted) of a stream of (key, event_id, ts): refused at `limit` counted events."""
    return _stateful(stream, _Limiter(key, ttl, ("event_id",), limit), f"{key} long, event_id long, ts timestamp, allowed boolean, counted int", lateness)


def circuit_breaker(stream: DataFrame, key: str, threshold: int, ttl: int = 600, lateness: str = "10 minutes") -> DataFrame:
    """(key, event_id, ts, failures, open) of a stream of (key, event_id, ts, failed): open at `threshold` failures, each within ttl of the one before; a success closes it."""
    return _stateful(stream, _Breaker(key, ttl, ("event_id", "failed"), threshold), f"{key} long, event_id long, ts timestamp, failures int, open boolean", lateness)
