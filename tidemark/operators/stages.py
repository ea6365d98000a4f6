"""Stages by name, the policies that a session's rows go through, and what a run is given from outside."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.functions.text import words
from tidemark.operators.sessions import PACES

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class Stages:
    """Transforms of DataFrames by name, in the order in which they were registered."""

    known: dict[str, Stage] = field(default_factory=dict)

    def register(self, name: str, stage: Stage) -> Stage:
        if name in self.known:
            raise ValueError(f"{name} is registered twice")
        self.known[name] = stage
        return stage

    def available(self, name: str) -> bool:
        return name in self.known

    def get(self, name: str) -> Stage:
        if name not in self.known:
            raise KeyError(f"{name} is none of {', '.join(self.known)}")
        return self.known[name]

    def plan(self, subset: tuple[str, ...] = (), mini: bool = False, first: int = 3) -> list[str]:
        """The names that run: a subset in the registered order, whatever `mini` says; else the first three or all."""
        if subset:
            return [n for n in self.known if n in subset]
        return list(self.known)[:first] if mini else list(self.known)

    def run(self, df: DataFrame, names: list[str] | None = None) -> DataFrame:
        """df through the named stages; each is a step of one plan, which runs once."""
        for name in self.plan() if names is None else names:
            df = df.transform(self.get(name))
        return df


def _consent(given: Column) -> Column:
    answer = F.upper(F.trim(given))
    return F.when(answer.isin("YES", "HOLD", "LATER"), answer).otherwise("HOLD")


@dataclass(frozen=True)
class Policies:
    """Functions from columns to columns, each of which can be another one: the pace of a session, whether it has consent,
    what is kept of it (null keeps nothing), how its end is marked, and how its input is given back, line for line."""

    pace: Callable[[Column], Column] = lambda given: F.when(given.isin(*PACES), given).otherwise("HOLD")
    consent: Callable[[Column], Column] = _consent
    diagnostics: Callable[[Column], Column] = lambda text: F.struct(F.size(words(text)).alias("words"), F.length(text).alias("chars"))
    completion: Callable[[Column], Column] = lambda text: F.concat(text, F.lit(" [[COMPLETE]]"))
    reflection: Callable[[Column], Column] = lambda text: F.split(text, "\\n", -1)

    def apply(self, df: DataFrame, text: str = "text", pace: str = "pace", consent: str = "consent", diagnostics: bool = True) -> DataFrame:
        """df with pace_state, consent_state, diagnostics, display_text and reflected. A text is marked as complete only with consent and the pace NOW."""
        c = F.col
        asked = df.withColumns({"pace_state": self.pace(c(pace)), "consent_state": self.consent(c(consent)), "reflected": self.reflection(c(text))})
        asked = asked.withColumn("display_text", F.when((c("pace_state") == "NOW") & (c("consent_state") == "YES"), self.completion(c(text))).otherwise(c(text)))
        kept = self.diagnostics(c(text))
        return asked.withColumn("diagnostics", kept if diagnostics else F.when(F.lit(False), kept))


@dataclass(frozen=True)
class Ports:
    """What a run takes from outside: the time, new names and a place for its counts; tests give fixed ones."""

    now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)
    new_id: Callable[[], str] = lambda: uuid.uuid4().hex
    count: Callable[[str, int, dict[str, str]], None] = lambda name, value, tags: None

    def stamped(self, df: DataFrame) -> DataFrame:
        """df with run_id and run_at, the same in all rows."""
        run_id = self.new_id()
        self.count("runs", 1, {"run": run_id})
        return df.withColumns({"run_id": F.lit(run_id), "run_at": F.lit(self.now())})


#: What becomes of a measure: a counter is added up, a timing averaged, a gauge replaced.
Sink = Callable[[str, str, float, dict[str, str]], None]


class Meter:
    """Measures of the rows that flow through a query, taken while it runs and without a job of their own.

    measures: by name a kind (counter, timing or gauge) and an aggregate Column. A batch query's values go to the sink by
    report(), once its action is done; those of a stream after each of its batches, by the listener. Nulls, which an
    aggregate over no rows has, are not sent.
    """

    def __init__(self, sink: Sink, measures: dict[str, tuple[str, Column]], tags: dict[str, str] | None = None):
        if odd := {k for k, _ in measures.values()} - {"counter", "timing", "gauge"}:
            raise ValueError(f"no such kind: {odd}")
        self.sink, self.measures, self.tags = sink, measures, tags or {}
        self.name, self._seen = f"meter-{uuid.uuid4().hex}", None

    def _columns(self) -> list[Column]:
        return [column.alias(name) for name, (_, column) in self.measures.items()]

    def send(self, values: dict, tags: dict[str, str] | None = None) -> None:
        for name, (kind, _) in self.measures.items():
            if values.get(name) is not None:
                self.sink(kind, name, float(values[name]), self.tags | (tags or {}))

    def batch(self, df: DataFrame) -> DataFrame:
        """df, measured by the next action on it."""
        self._seen = Observation(self.name)
        return df.observe(self._seen, *self._columns())

    def report(self) -> None:
        """Waits for the action of batch()'s rows, and sends what was measured."""
        if self._seen is None:
            raise ValueError("nothing was measured")
        self.send(self._seen.get)

    def stream(self, df: DataFrame) -> DataFrame:
        """A streaming df, measured in each batch while listener() is added to the session."""
        return df.observe(self.name, *self._columns())

    def listener(self) -> StreamingQueryListener:
        meter = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                pass

            def onQueryProgress(self, event):
                row = event.progress.observedMetrics.get(meter.name)
                if row is not None and event.progress.numInputRows:
                    meter.send(row.asDict(), {"batch": str(event.progress.batchId)})

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                pass

        return Listener()
