"""A token bucket for each key: as a batch over a table of requests, and as a stateful stream with the same fold."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

IDLE_SECONDS = 3600
RESULT = "request_id long, key string, allowed boolean, retry_after int"


def take(tokens: float, last: float | None, now: float, rpm: int) -> tuple[float, bool, int]:
    """One request at ``now``: the tokens left, whether it passes, and the seconds to wait if not. 0 a minute is no limit."""
    if rpm <= 0:
        return tokens, True, 0
    if last is None or now - last > IDLE_SECONDS:
        tokens = float(rpm)
    else:
        tokens = min(float(rpm), tokens + max(0.0, now - last) * rpm / 60)
    if tokens >= 1:
        return tokens - 1, True, 0
    return tokens, False, max(1, math.ceil((1 - tokens) / (rpm / 60)))


def _fold(rows: Iterator[tuple[int, str, float]], tokens: float, last: float | None, rpm: int) -> tuple[pd.DataFrame, float, float | None]:
    out = []
    for request_id, key, now in rows:
        tokens, allowed, wait = take(tokens, last, now, rpm)
        last = now
        out.append((request_id, key, allowed, wait))
    return pd.DataFrame(out, columns=["request_id", "key", "allowed", "retry_after"]), tokens, last


def admit(requests: DataFrame, rpm: int) -> DataFrame:
    """(request_id, key, at) -> request_id, key, allowed, retry_after.

    Requests are sorted by key and time inside partitions and folded as they stream by, so a busy key is never held in memory.
    """
    rows = requests.select("request_id", "key", F.col("at").cast("double").alias("at")).repartition("key").sortWithinPartitions("key", "at", "request_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tokens, last = None, 0.0, None
        for pdf in batches:
            for k, own in pdf.groupby("key", sort=False, dropna=False):
                k = None if pd.isna(k) else k  # requests without a key share one
                if k != key or last is None:
                    key, tokens, last = k, 0.0, None
                out, tokens, last = _fold(own.itertuples(index=False, name=None), tokens, last, rpm)
                yield out

    return rows.mapInPandas(run, RESULT)


class _Bucket(StatefulProcessor):
    """A key's tokens and the time of its last request; a timer at the end of the idle time removes them."""

    def __init__(self, rpm: int):
        self.rpm = rpm

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("bucket", "tokens double, last double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tokens, last = self.state.get() if self.state.exists() else (0.0, None)
        own = pd.concat(list(rows)).sort_values(["at", "request_id"])
        out, tokens, last = _fold(zip(own["request_id"], own["key"], own["at"], strict=True), tokens, last, self.rpm)
        self.state.update((tokens, last))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int((last + IDLE_SECONDS) * 1000) + 1)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, rpm: int, late: str = "10 seconds") -> DataFrame:
    """The same on a stream (request_id, key, at: timestamp), whose keys lose their state once the watermark says that they have been idle.

    Requests of one micro-batch are taken in the order of time, and a request that is later than ``late`` is dropped with the watermark. It needs
    a state store with timers (RocksDB).
    """
    rows = requests.withWatermark("at", late).select("request_id", "key", F.col("at").alias("event_time"), F.col("at").cast("double").alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(_Bucket(rpm), RESULT, "Append", "EventTime")
