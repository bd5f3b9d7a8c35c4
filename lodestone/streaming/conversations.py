"""The conversation store: messages by conversation, forgotten a while after the last one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.streaming.state import in_order, stored_in_rocks

TTL = 28_800
SCHEMA = "conv_id long, created_at timestamp, last_seen timestamp, n_messages int, recent string"


class _Conversation(StatefulProcessor):
    """When a conversation began and was last seen, and how many messages it has, in a value; the last of them in a list. A timer drops both."""

    def __init__(self, ttl: int, keep: int):
        self.ttl, self.keep = ttl, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "created long, last long, n int")
        self.recent = handle.getListState("recent", "line string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        created, last, n = self.seen.get() if self.seen.exists() else (0, 0, 0)
        recent = [line for (line,) in self.recent.get()] if n else []
        for now, _, role, content in in_order(rows, ("turn", "role", "content"), "turn"):
            if not n or now - last >= self.ttl * 1_000_000:
                created, last, n, recent = now, now, 0, []
            last, n = max(last, now), n + 1
            recent = [*recent, f"{'User' if role == 'user' else 'Assistant'}: {'' if content is None else content}"][-self.keep :]
        self.seen.update((int(created), int(last), int(n)))
        self.recent.put([(line,) for line in recent])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(last // 1000 + self.ttl * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame([{"conv_id": key[0], "created_at": pd.Timestamp(created, unit="us"), "last_seen": pd.Timestamp(last, unit="us"), "n_messages": n, "recent": "\n".join(recent)}])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.recent.clear()
        yield from ()

    def close(self) -> None:
        pass


def conversation_store(stream: DataFrame, ttl: int = TTL, keep: int = 4, lateness: str = "10 minutes") -> DataFrame:
    """The state of a conversation after each micro-batch of its messages (conv_id, turn, role, content, ts).

    A message later than ttl after the one before it begins the conversation anew; state is dropped once the watermark
    has passed its time to live. recent holds the last `keep` messages as lines. A message that comes late, but within the
    watermark, follows those that came before it and doesn't turn the conversation's time back.
    """
    stored_in_rocks(stream.sparkSession)
    return stream.withWatermark("ts", lateness).groupBy("conv_id").transformWithStateInPandas(_Conversation(ttl, keep), SCHEMA, "Update", "EventTime")
