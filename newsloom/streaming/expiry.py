"""Chat sessions that end when they have been idle: keyed state with event-time timers.

Each session keeps its open runs of activity and the last messages of each.  A
run ends once the watermark has passed its last message by more than the idle
limit; until then rows may come in any order and join runs.  Reads leave no
message, so they keep no session alive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsloom import constants as C
from newsloom.streaming.incremental import PROVIDER, ROCKS, run_to_folder

ENDED = "session_id string, messages long, started timestamp, last_active timestamp, kept array<long>"
RUN = "started long, last long, n long, tail_ts array<long>, tail_seq array<long>"

Run = tuple[int, int, int, list[int], list[int]]   # microseconds; the tail holds the newest messages


def runs_of(ts: np.ndarray, seq: np.ndarray, idle: int, limit: int) -> list[Run]:
    """Runs of messages with gaps of at most ``idle``."""
    order = np.lexsort((seq, ts))
    ts, seq = ts[order], seq[order]
    cuts = np.flatnonzero(np.diff(ts) > idle) + 1
    return [(int(t[0]), int(t[-1]), len(t), t[-limit:].tolist(), s[-limit:].tolist())
            for t, s in zip(np.split(ts, cuts), np.split(seq, cuts)) if len(t)]


def merged_runs(runs: list[Run], idle: int, limit: int) -> list[Run]:
    """Runs that touch, or lie no more than ``idle`` apart, made one."""
    out: list[Run] = []
    for run in sorted(runs):
        if not out or run[0] - out[-1][1] > idle:
            out.append(run)
            continue
        a = out[-1]
        tail = sorted(zip(a[3] + run[3], a[4] + run[4]))[-limit:]
        out[-1] = (a[0], max(a[1], run[1]), a[2] + run[2], [t for t, _ in tail], [s for _, s in tail])
    return out


class SessionExpiry(StatefulProcessor):
    """Emits a run of activity when it has been idle for more than ``minutes``."""

    def __init__(self, minutes: int, limit: int) -> None:
        self.idle, self.limit = minutes * 60_000_000, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", RUN)

    def _due(self, run: Run) -> int:
        return (run[1] + self.idle) // 1000 + 1

    def _keep(self, runs: list[Run]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if runs:
            self.runs.put(runs)
            self.handle.registerTimer(min(map(self._due, runs)))
        else:
            self.runs.clear()

    def _held(self) -> list[Run]:
        return [(r[0], r[1], r[2], list(r[3]), list(r[4])) for r in self.runs.get()] if self.runs.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = self._held()
        for piece in rows:  # in Arrow pieces, in any order
            ts = piece["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            runs = merged_runs(runs + runs_of(ts, piece["seq"].to_numpy(np.int64), self.idle, self.limit),
                               self.idle, self.limit)
        self._keep(runs)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, runs = timerValues.getCurrentWatermarkInMs(), self._held()
        ended = [r for r in runs if self._due(r) < now]
        self._keep([r for r in runs if self._due(r) >= now])
        if ended:
            moment = lambda k: pd.to_datetime([r[k] for r in ended], unit="us")
            yield pd.DataFrame({"session_id": key[0], "messages": [r[2] for r in ended], "started": moment(0),
                                "last_active": moment(1), "kept": [r[4] for r in ended]})

    def close(self) -> None:
        pass


def ended_sessions(messages: DataFrame, minutes: int = C.SESSION_TTL_MINUTES, limit: int = C.SESSION_MESSAGE_LIMIT,
                   late: str = "10 minutes") -> DataFrame:
    """Stream of ended runs of ``messages (session_id, seq, ts)``; append mode.

    Rows with a null session or time are passed over.  Rows that come after the
    watermark (newest time less ``late``) has passed them are dropped by Spark.
    The state store has to be RocksDB when the stream starts: :func:`run_expiry`.
    """
    usable = messages.select(F.col("session_id").cast("string").alias("session_id"), F.col("seq").cast("long").alias("seq"),
                             F.col("ts").cast("timestamp").alias("ts")).filter(
        "session_id IS NOT NULL AND ts IS NOT NULL AND seq IS NOT NULL")
    return usable.withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(
        SessionExpiry(minutes, limit), ENDED, "append", "eventTime")


def run_expiry(messages: DataFrame, target: str, checkpoint: str, **options) -> None:
    """Drain what has arrived: ended runs go to ``target``, open ones stay in the state below ``checkpoint``."""
    spark = messages.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # a stream keeps the store it was started with
    try:
        run_to_folder(ended_sessions(messages, **options), target, checkpoint)
    finally:
        spark.conf.set(PROVIDER, before)
