"""State machines with timers in event time, as a stateful processor for each key.

A state may hold a timer: set when the state is entered, cancelled when it is left. It falls due so long
after the entry. An interrupting timer moves the machine to its target; the other kind gives a row and leaves the
state. A timer fires in the order of event time: before the key's next event if that comes later than
the deadline, else, if the key falls silent, once the watermark has passed it. A machine that is back in
its start state, which holds no timer, keeps no state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Timer:
    """A state's timer: seconds after the entry, where it leads (None: nowhere, it only reminds), the cause that its row names."""

    after_s: int
    to: str | None
    cause: str = "timer"


@contextmanager
def timer_state(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, for streams that start within."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class _Machine(StatefulProcessor):
    """One key's machine. Its value state: the state's name, the moment it was entered, whether its timer is still set."""

    def __init__(self, moves: dict[tuple[str, str], str], timers: dict[str, Timer], start: str) -> None:
        self.moves, self.timers, self.start = moves, timers, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, since long, set boolean")

    def _load(self) -> tuple[str, int, bool]:
        return tuple(self.now.get()) if self.now.exists() else (self.start, 0, False)

    def _due(self, state: str, since: int, is_set: bool) -> int | None:
        return since + self.timers[state].after_s * 1_000_000 if is_set else None

    def _store(self, state: str, since: int, is_set: bool) -> None:
        """Keep the state and set its one timer anew; a machine at its start keeps nothing."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        due = self._due(state, since, is_set)
        if state == self.start and due is None:
            self.now.clear()
            return
        self.now.update((state, since, is_set))
        if due is not None:
            self.handle.registerTimer(-(-due // 1000))

    def _fire(self, state: str, since: int, out: list[tuple]) -> tuple[str, int, bool]:
        timer, due = self.timers[state], self._due(state, since, True)
        to = timer.to or state
        out.append((due, state, to, timer.cause))
        return (state, since, False) if timer.to is None else (to, due, to in self.timers)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        state, since, is_set = self._load()
        out: list[tuple] = []
        for at, _, event in sorted((int(a), int(s), e) for f in rows for a, s, e in zip(f["at_us"], f["seq"], f["event"], strict=True)):
            while is_set and self._due(state, since, is_set) <= at:
                state, since, is_set = self._fire(state, since, out)
            to = self.moves.get((state, event), state)
            out.append((at, state, to, event))
            if to != state:
                state, since, is_set = to, at, to in self.timers
        self._store(state, since, is_set)
        yield _frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, since, is_set = self._load()
        out: list[tuple] = []
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        while is_set and self._due(state, since, is_set) <= mark:
            state, since, is_set = self._fire(state, since, out)
        self._store(state, since, is_set)
        yield _frame(key, out)

    def close(self) -> None:
        pass


def _frame(key: tuple, out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(key[0], *row) for row in out], columns=["key", "at_us", "before", "after", "cause"])


def timed_machine(stream: DataFrame, key: str, at: str, seq: str, event: str, cap: str, moves: dict[tuple[str, str], str], timers: dict[str, Timer], start: str) -> DataFrame:
    """key, at_us, before, after, cause (the event, or a timer's name) of a machine for each value of ``key`` (long).

    Events are taken in the order of ``at`` and ``seq`` within a batch; those older than the watermark (the
    largest ``at`` less ``cap``) are dropped. Start the stream within ``timer_state``.
    """
    if start in timers:
        raise ValueError("the start state can't hold a timer: its keys keep no state")
    rows = stream.withWatermark(at, cap).select(F.col(key).alias("key"), F.col(at).alias("_at"), F.unix_micros(at).alias("at_us"), F.col(seq).alias("seq"), F.col(event).alias("event"))
    return rows.groupBy("key").transformWithStateInPandas(_Machine(moves, timers, start), "key long, at_us long, before string, after string, cause string", "Append", "EventTime")


