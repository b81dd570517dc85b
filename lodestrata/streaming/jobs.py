"""The stage machine of jobs on a stream of stage events, with a timer that fails a job that falls silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# How far a job is when a stage begins, and the states that it ends in.
PROGRESS = {"queued": 0, "cloning": 10, "parsing": 25, "analyzing": 45, "graph-building": 65, "scoring": 80, "embedding": 90, "completed": 100, "partial": 100, "failed": 100}
FINAL = ("completed", "partial", "failed")
RESULT = "job_id long, status string, current_stage string, progress int, at timestamp, message string"


def step(state: tuple | None, stage: str, status: str, at: float) -> tuple[tuple, str | None]:
    """(status, stage, progress, at) after an event, and a message if the job has failed by it. A job that has ended stays as it is.

    A stage that runs is the job's status; progress never falls; a stage that fails fails its job; a final state ends it.
    """
    if state is not None and state[0] in FINAL:
        return state, None
    now, current, progress, _ = state or ("queued", "queued", 0, at)
    if stage in FINAL:
        return (stage, current, 100, at), "stage failed" if stage == "failed" else None
    if status == "failed":
        return ("failed", stage, progress, at), f"{stage} failed"
    if status == "running":
        return (stage, stage, max(progress, PROGRESS.get(stage, 0)), at), None
    return (now, current, progress, at), None


class _Machine(StatefulProcessor):
    def __init__(self, timeout: float):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", "status string, stage string, progress int, at double")

    def _out(self, key, state, message) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "status": [state[0]], "current_stage": [state[1]], "progress": [state[2]], "at": [pd.Timestamp(state[3], unit="s")], "message": [message]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else None
        own, message = pd.concat(list(rows)).sort_values(["at", "event_id"]), None
        for stage, status, at in zip(own["stage"], own["status"], own["at"], strict=True):
            state, said = step(state, stage, status, at)
            message = said or message
        self.state.update(state)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        # a job that runs may fall silent; one that has ended is forgotten after as long
        self.handle.registerTimer(int((state[3] + self.timeout) * 1000))
        yield self._out(key, state, message)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.state.get()
        self.state.clear()
        if state[0] not in FINAL:
            yield self._out(key, ("failed", state[1], state[2], state[3] + self.timeout), f"stale while {state[0]}")

    def close(self) -> None:
        pass


def job_states(events: DataFrame, timeout: float, late: str = "10 seconds") -> DataFrame:
    """(event_id, job_id, stage, status, at: timestamp) as a stream -> a row for each job and micro-batch in which it changes: status,
    current_stage, progress, at and message. A job without an event for ``timeout`` seconds of event time fails; an ended one loses its state then.

    It needs a state store with timers (RocksDB).
    """
    rows = events.withWatermark("at", late).select("event_id", "job_id", "stage", "status", F.col("at").alias("event_time"), F.col("at").cast("double").alias("at"))
    return rows.groupBy("job_id").transformWithStateInPandas(_Machine(timeout), RESULT, "Append", "EventTime")
