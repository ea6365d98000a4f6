"""Stateful operators with list and value state in RocksDB, times to live and timers.

A key's rows of a batch come in pieces; of each only the numbers that are needed are kept, and of what came before only the
state. The state of a rolling percentile is `last` numbers a key; that of a debounced path is one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.ordered import window_percentiles

PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB."""
    before = {k: spark.conf.get(k, None) for k in PROVIDER}
    try:
        for k, v in PROVIDER.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _micros(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype("int64").to_numpy()


def _sorted(rows: Iterator[pd.DataFrame], columns: list[str]) -> list[np.ndarray]:
    """at, event_id and some columns of a key's rows in a batch, in order of the first two."""
    held = [[] for _ in range(2 + len(columns))]
    for piece in rows:
        for to, x in zip(held, (_micros(piece["at"]), piece["event_id"].to_numpy(), *(piece[c].to_numpy() for c in columns))):
            to.append(x)
    made = [np.concatenate(x) for x in held]
    order = np.lexsort((made[1], made[0]))
    return [x[order] for x in made]


class Rolling(StatefulProcessor):
    """A ring of the last values in a ListState, how many there were in a ValueState; both go `ttl_ms` after their last change."""

    def __init__(self, last: int, every: int, share: float, ttl_ms: int | None):
        self.last, self.every, self.share, self.ttl_ms = last, every, share, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "value double", self.ttl_ms)
        self.seen = handle.getValueState("seen", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        _, _, new = _sorted(rows, ["value"])
        new = new.astype(float)
        before = np.array([r[0] for r in self.held.get()], float) if self.held.exists() else np.zeros(0)
        seen = self.seen.get()[0] if self.seen.exists() else 0
        values = np.concatenate([before, new])
        counts = np.arange(seen - seen % self.every + self.every, seen + len(new) + 1, self.every)
        found = window_percentiles(values, self.last, self.share)[counts - seen + len(before) - 1]
        self.held.put([(float(v),) for v in values[-self.last :]])
        self.seen.update((int(seen + len(new)),))
        yield pd.DataFrame({"key": [key[0]] * len(counts), "seen": counts, "p": found})

    def close(self) -> None:
        pass


def rolling(events: DataFrame, key: str, last: int = 200, every: int = 10, share: float = 0.95, ttl_ms: int | None = None) -> DataFrame:
    """(key, seen, p) after each `every` events of a key: the interpolated percentile of its last `last` values. events: key,
    at (timestamp), event_id, value. A batch's events of a key are taken by time, later batches after it. With ttl_ms the state of a
    key goes so long after its last event; Spark then makes batches without data for ever, so such a stream has a trigger by time."""
    named = events.select(F.col(key).alias("key"), "at", "event_id", F.col("value").cast("double").alias("value"))
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return named.groupBy("key").transformWithStateInPandas(Rolling(last, every, share, ttl_ms), "key string, seen long, p double", "Append", mode)


class FirstOfBurst(StatefulProcessor):
    """What a path held last and when its last write counted."""

    def __init__(self, quiet: float):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("known", "hash string, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, last = self.state.get() if self.state.exists() else (None, None)
        out = []
        for at, ident, content in zip(*(x.tolist() for x in _sorted(rows, ["hash"]))):
            if content is None or content != content:
                if known is not None:
                    out.append((key[0], ident, "deleted"))
                    known = None
            elif (last is None or at - last >= self.quiet * 1e6) and content != known:
                out.append((key[0], ident, "created" if known is None else "modified"))
                known, last = content, at
        self.state.update((known, last))
        yield pd.DataFrame(out, columns=["path", "event_id", "change"])

    def close(self) -> None:
        pass


class LastOfBurst(StatefulProcessor):
    """What is known of a path, and a change that waits until its path has been quiet; a timer ends the wait."""

    def __init__(self, quiet: float, clock: str):
        self.quiet, self.by_event = int(quiet * 1e6), clock == "event"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("change", "known string, hash string, event_id long, at long, waits boolean, n long")

    def _told(self, path, known, content, ident, at, n) -> tuple | None:
        change = ("created" if known is None else "modified") if content is not None else "deleted"
        return None if content == known else (path, ident, change, pd.Timestamp(at, unit="us"), n)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, content, ident, at, waits, n = self.state.get() if self.state.exists() else (None, None, None, None, False, 0)
        out = []
        for now, event, new in zip(*(x.tolist() for x in _sorted(rows, ["hash"]))):
            new = None if new != new else new
            if waits and now - at > self.quiet and self.by_event:
                out.append(self._told(key[0], known, content, ident, at, n))
                known, n = content, 0
            content, ident, at, waits, n = new, event, max(now, at or now), True, n + 1
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, (tuple, list)) else old)
        due = at // 1000 + self.quiet // 1000 + 1 if self.by_event else timerValues.getCurrentProcessingTimeInMs() + self.quiet // 1000
        self.handle.registerTimer(int(due))
        self.state.update((known, content, ident, at, waits, n))
        yield from self._frames(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, content, ident, at, waits, n = self.state.get()
        out = [self._told(key[0], known, content, ident, at, n)] if waits else []
        self.state.update((content, content, ident, at, False, 0))
        yield from self._frames(out)

    @staticmethod
    def _frames(rows: list) -> Iterator[pd.DataFrame]:
        """A key that tells nothing has no frame: most keys of a batch."""
        if told := [r for r in rows if r is not None]:
            yield pd.DataFrame(told, columns=["path", "event_id", "change", "at", "n"]).astype({"at": "datetime64[us]", "event_id": "Int64", "n": "Int64"})

    def close(self) -> None:
        pass


def first_of_burst(changes: DataFrame, quiet: float = 2.0) -> DataFrame:
    """(path, event_id, change): the file events (path, event_id, at, hash; a null hash is a deletion) that start an update.

    A write counts if `quiet` seconds have passed since the path's last one that counted and its content differs from the
    one known then; a deletion counts if the path is known, and forgets its content. change: created, modified or deleted.
    """
    return changes.select("path", "event_id", "at", "hash").groupBy("path").transformWithStateInPandas(FirstOfBurst(quiet), "path string, event_id long, change string", "Append", "None")


def last_of_burst(changes: DataFrame, quiet: float = 2.0, clock: str = "event", together: bool = False, late: str = "0 seconds") -> DataFrame:
    """(path, event_id, change, at, n): the last of a path's events (path, event_id, at, hash) that follow each other within
    `quiet` seconds, once it has been quiet for longer, if its content is not the one known; n events were one change.

    clock: event, by the times of the events and their watermark, or processing, by the clock of the machine. together: all
    paths are quiet or not together, as one named *; its event is the last one of any path.
    """
    path = F.lit("*") if together else F.col("path")
    kept = changes.select(path.alias("path"), "event_id", "at", F.concat_ws(":", F.col("path"), F.coalesce("hash", F.lit(""))).alias("hash") if together else F.col("hash"))
    kept = kept.withWatermark("at", late) if clock == "event" else kept
    mode = "EventTime" if clock == "event" else "ProcessingTime"
    return kept.groupBy("path").transformWithStateInPandas(LastOfBurst(quiet, clock), "path string, event_id long, change string, at timestamp, n long", "Append", mode)
