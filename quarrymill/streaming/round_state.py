"""The state of labelling rounds as a stream: events of each project come in, what to do goes out.

Each project's state (training, deferred, armed) is kept by Spark and goes through rounds.step(). A training that tells nothing for
`patience` is taken for failed, by a timer that every event of the training sets anew. State and timers are in the query's
checkpoint, so a stream that is stopped and started again tells each notice once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.rounds import RoundState, step

#: Events are told in this order if they have one time.
EVENTS = "project string, event string, ts timestamp"
ACTIONS = "project string, event string, action string, training boolean, deferred boolean, armed boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Rounds(StatefulProcessor):
    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("round", "training boolean, deferred boolean, armed boolean, timer long")

    def _told(self, key, events: list[str], now: int) -> pd.DataFrame:
        held = self.state.get() if self.state.exists() else None
        state, timer = (RoundState(*held[:3]), held[3]) if held else (RoundState(), 0)
        out = []
        for event in events:
            if event != "training_step":
                state, action = step(state, event)
                out.append((key[0], event, action, state.training, state.deferred, state.armed))
        if timer:
            self.handle.deleteTimer(timer)
        timer = now + self.patience if state.training and self.patience else 0
        if timer:
            self.handle.registerTimer(timer)
        self.state.update((state.training, state.deferred, state.armed, timer))
        return pd.DataFrame(out, columns=["project", "event", "action", "training", "deferred", "armed"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "event"], kind="stable")
        yield self._told(key, pdf["event"].tolist(), timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[3] == expiredTimerInfo.getExpiryTimeInMs():
            held = self.state.get()
            self.state.update((*held[:3], 0))
            yield self._told(key, ["training_failed"], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def actions(events: DataFrame, patience_ms: int = 0) -> DataFrame:
    """What to do (setup, notice or nothing) on each event (project, event, ts) of a stream, with the state after it; events as
    rounds.step() knows them, and training_step, which only shows that a training lives. Events of a project within one batch
    are taken by time. patience_ms: 0 for no timer; with timers a stream has batches without events, too. The session needs RocksDB as its state store (PROVIDER)."""
    return events.groupBy("project").transformWithStateInPandas(_Rounds(patience_ms), ACTIONS, "Append", "ProcessingTime" if patience_ms else "None")
