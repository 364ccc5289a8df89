"""Streams with a state of their own a key: models that every batch updates, and jobs that go stale by a timer.

State lives in the state store, a value or a list a key, and is restored with the checkpoint; sinks take each row once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillmart.streaming.windows import collected

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for the streams started inside; the session's own afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def run(stream: DataFrame, name: str) -> DataFrame:
    """The rows that a keyed stream gives for what is there."""
    with rocks(stream.sparkSession):
        return collected(stream, name)


# models kept up to date


class _Model(StatefulProcessor):
    """One arm's sums; every batch that has rows of it gives its model anew."""

    def __init__(self, d: int, ridge: float):
        self.d, self.ridge = d, ridge

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n bigint, a array<double>, b array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, a, b = 0, np.zeros(self.d * self.d), np.zeros(self.d)
        if self.sums.exists():
            n, a, b = self.sums.get()
            a, b = np.array(a), np.array(b)
        for part in rows:
            n += int(part["n"].sum())
            a, b = a + np.sum(np.stack(part["a"]), axis=0), b + np.sum(np.stack(part["b"]), axis=0)
        self.sums.update((n, a.tolist(), b.tolist()))
        theta = np.linalg.solve(a.reshape(self.d, self.d) + self.ridge * np.eye(self.d), b)
        yield pd.DataFrame({"arm": [key[0]], "n": [n], "a": [a.tolist()], "b": [b.tolist()], "theta": [theta.tolist()]})

    def close(self) -> None:
        pass


def _partial_sums(frames: Iterator[pd.DataFrame], context: list[str]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for arm, g in f.groupby("arm", dropna=False):
            z = np.column_stack([np.ones(len(g)), *(g[c].to_numpy(float) for c in context)])
            out.append((None if pd.isna(arm) else arm, len(g), (z.T @ z).ravel().tolist(), (z.T @ g["reward"].to_numpy(float)).tolist()))
        yield pd.DataFrame(out, columns=["arm", "n", "a", "b"])


def arm_models(log: DataFrame, context: list[str], ridge: float = 1.0) -> DataFrame:
    """arm, n, a, b, theta after each batch that holds rows of the arm: the sums of ``log(arm, reward, *context)`` so far and the ridge model they give.

    ``a`` has the rows of the matrix of sums of products one after the other, its first column the constant. Rows with
    a null reward or context take no part; a null arm is an arm. Frames are summed before they are shuffled, so an arm
    that has a third of all rows sends as few as any other.
    """
    known = log.select(F.col("arm").cast("string"), F.col("reward").cast("double"), *(F.col(c).cast("double").alias(c) for c in context)).dropna(subset=["reward", *context])
    sums = known.mapInPandas(lambda frames: _partial_sums(frames, context), "arm string, n long, a array<double>, b array<double>")
    return sums.groupBy("arm").transformWithStateInPandas(_Model(len(context) + 1, ridge), "arm string, n long, a array<double>, b array<double>, theta array<double>", "append", "none")


def latest_models(updates: DataFrame) -> DataFrame:
    """Each arm's model after the last batch that reached it."""
    return updates.groupBy("arm").agg(F.max_by(F.struct("n", "a", "b", "theta"), "n").alias("_m")).select("arm", "_m.*")


# jobs that go stale


class _Stale(StatefulProcessor):
    """One job's last settled event, and those newer than the watermark, whose order isn't known yet.

    Times are microseconds. Events are settled in order once the watermark has passed them. A timer stands at the next
    moment at which something can change: the oldest open event, or the deadline of the last settled one.
    """

    def __init__(self, limits: dict[str, int]):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint, state string")
        self.open = handle.getListState("open", "at bigint, state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = [(int(at), state) for part in rows for at, state in zip(part["at"], part["state"], strict=True)]
        yield from self._settle(key, [*self.open.get(), *events], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, list(self.open.get()), timerValues)

    def _settle(self, key, events, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted((int(at), state) for at, state in events)
        last = self.last.get() if self.last.exists() else None
        found = []

        def ended(until: int) -> bool:
            if last is None or last[1] not in self.limits or last[0] + self.limits[last[1]] >= until:
                return False
            found.append((*last, last[0] + self.limits[last[1]]))
            return True

        ripe = [e for e in events if e[0] <= mark]
        for event in ripe:
            ended(event[0])
            last = event
        if ended(mark + 1):
            last = None
        waiting = events[len(ripe) :]
        if last is not None and last[1] in self.limits:
            self.last.update(last)
        else:
            self.last.clear()
            last = None
        if waiting:
            self.open.put(waiting)
        else:
            self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        moments = [e[0] for e in waiting[:1]] + ([last[0] + self.limits[last[1]]] if last else [])
        if moments:
            # the first millisecond that isn't before it
            self.handle.registerTimer(max(-(-min(moments) // 1000), mark // 1000 + 1))
        if found:
            yield pd.DataFrame({"job": [key[0]] * len(found), "state": [f[1] for f in found], "since": [f[0] for f in found], "failed": [f[2] for f in found]})

    def close(self) -> None:
        pass


def stale(events: DataFrame, job: str, at: str, state: Column, minutes: dict[str, float], delay: str) -> DataFrame:
    """job, state, since, failed of jobs that stayed in a state for longer than its ``minutes``: ``failed`` is when they ran out.

    States without minutes are final. A job fails by its timer, once the watermark (``delay`` behind the newest event
    of any job) has passed its deadline, so it needs no further event of its own; an event at the deadline is in
    time. Events later than ``delay`` are dropped once a batch has settled what comes after them, others count in the order of their times, whatever batch brought
    them; of equal times the greater state comes last. A failed job's next event starts it anew. Rows with a null job
    are one job, those with a null time or state take no part. State is kept for jobs that are neither final nor
    failed, and for their events of the last ``delay``.
    """
    rows = events.where(F.col(at).isNotNull()).withWatermark(at, delay)
    rows = rows.select(F.col(job).cast("string").alias("job"), F.col(at), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), state.alias("state")).where("state is not null")
    limits = {name: round(m * 60_000_000) for name, m in minutes.items()}
    found = rows.groupBy("job").transformWithStateInPandas(_Stale(limits), "job string, state string, since long, failed long", "append", "eventTime")
    return found.select("job", "state", F.timestamp_micros("since").alias("since"), F.timestamp_micros("failed").alias("failed"))
