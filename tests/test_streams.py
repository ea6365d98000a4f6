"""Followed logs, state with timers, and restarts."""

from __future__ import annotations

import json
import random
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans import streams
from tidemark.sources import files
from tidemark.streaming import follow, stateful, tail

LINE = T.StructType([T.StructField("i", T.LongType()), T.StructField("ts", T.StringType())])


def line(i):
    return json.dumps({"i": i, "ts": f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}"}) + "\n"


def test_a_log_is_followed_over_growth_rotation_and_restarts(spark, tmp_path):
    log, sink, marks = tmp_path / "log", files.folder(spark, "sink"), files.folder(spark, "marks")
    log.mkdir()

    def rows():
        return sorted(r["i"] for r in tail.drain(follow.events(spark, f"file://{log}", LINE, split=64), "f", sink, marks).collect())

    (log / "a.json").write_text("".join(map(line, range(20))) + line(20)[:9])
    assert rows() == list(range(20))
    # the line that was not ended goes on; a line that is no JSON goes
    with open(log / "a.json", "a") as f:
        f.write(line(20)[9:] + "{bad\n" + line(21))
    (log / "b.json").write_text(line(100))
    assert rows() == [*range(22), 100]
    assert rows() == [*range(22), 100]
    # a rotation: the old file has another name and a last line, the new one begins anew
    (log / "a.json").rename(log / "a.json.1")
    with open(log / "a.json.1", "a") as f:
        f.write(line(22))
    (log / "a.json").write_text(line(200) + line(201))
    assert rows() == [*range(23), 100, 200, 201]
    (log / "b.json").unlink()
    with open(log / "a.json", "a") as f:
        f.write("é" * 40 + "\n" + line(202))
    assert rows() == [*range(23), 100, 200, 201, 202]


def test_following_from_the_end_and_since(spark, tmp_path):
    sink, marks = files.folder(spark, "sink"), files.folder(spark, "marks")
    (tmp_path / "a.json").write_text("".join(map(line, range(5))))
    stream = lambda: follow.events(spark, f"file://{tmp_path}", LINE, start="end")
    assert tail.drain(stream(), "f", sink, marks).count() == 0
    with open(tmp_path / "a.json", "a") as f:
        f.write(line(5))
    assert [r["i"] for r in tail.drain(stream(), "f", sink, marks).collect()] == [5]
    assert sorted(r["i"] for r in tail.drain(follow.events(spark, f"file://{tmp_path}", LINE, since="2024-01-01 00:00:03"), "s").collect()) == [3, 4, 5]
    assert tail.drain(follow.lines(spark, f"file://{tmp_path}/none"), "n").count() == 0


def test_pieces_of_any_size_have_each_line_once(tmp_path):
    rng = random.Random(1)
    data = b"".join(b"x" * rng.randrange(0, 30) + b"\n" for _ in range(200))
    (tmp_path / "a.json").write_bytes(b"first\n" + data + b"not ended")
    for split in (1, 7, 64, 100_000):
        reader = follow.FollowReader({"path": f"file://{tmp_path}", "split": str(split)})
        end = reader.latestOffset()
        found = [r for p in reader.partitions({}, end) for r in reader.read(p)]
        assert [r[2] for r in found] == (b"first\n" + data).decode().split("\n")[:-1] and len({r[1] for r in found}) == len(found)
        half = dict.fromkeys(end, found[100][1])
        assert [r[1] for p in reader.partitions(half, end) for r in reader.read(p)] == [r[1] for r in found[100:]]


def test_rolling_percentiles_go_on_after_a_restart(spark, tmp_path):
    rng = np.random.default_rng(2)
    path, sink, marks = str(tmp_path / "in"), files.folder(spark, "sink"), files.folder(spark, "marks")
    schema = "key string, at timestamp, event_id long, value double"
    truth = {"a": [], "b": []}
    for batch in range(4):
        rows = []
        for k in range(90):
            key, v = "a" if rng.random() < 0.8 else "b", float(rng.normal())
            rows.append((key, datetime.fromtimestamp(1_700_000_000 + batch * 1000 + k, timezone.utc).replace(tzinfo=None), batch * 1000 + k, v))
            truth[key].append(v)
        rng.shuffle(rows)
        spark.createDataFrame([(a, b, int(c), float(d)) for a, b, c, d in rows], schema).coalesce(3).write.mode("append").parquet(path)
        if batch % 2:
            stream = tail.source(spark, path, T._parse_datatype_string(schema), None)
            got = tail.drain(stateful.rolling(stream, "key", last=25, every=7), "r", sink, marks)
    found = {(r["key"], r["seen"]): r["p"] for r in got.collect()}
    wanted = {(k, n): np.percentile(v[max(0, n - 25) : n], 95) for k, v in truth.items() for n in range(7, len(v) + 1, 7)}
    # the two files of a run are one batch or two, and in a batch rows go by time
    assert found.keys() == wanted.keys() and all(abs(found[k] - p) < 1e-9 for k, p in wanted.items())


class Handle:
    """State and timers of one key, by hand."""

    def __init__(self):
        self.row, self.timers = None, set()

    def getValueState(self, name, schema, ttl=None):
        return self

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def registerTimer(self, at):
        self.timers.add(at)


class Clock:
    def __init__(self):
        self.now = 0

    def getCurrentProcessingTimeInMs(self):
        return self.now


def driven(events, quiet, key="p"):
    """What a debounce by the machine's clock tells, of events (ms, id, hash), with the clock moved from one to the next."""
    handle, clock, told = Handle(), Clock(), []
    step = stateful.LastOfBurst(quiet, "processing")
    step.init(handle)

    def until(now):
        for due in sorted(t for t in handle.timers if t <= now):
            handle.timers.discard(due)
            clock.now = due
            for frame in step.handleExpiredTimer((key,), clock, None):
                told.extend((due, r.event_id, r.change, r.n) for r in frame.itertuples())
        clock.now = now

    for now, ident, content in events:
        until(now)
        frame = pd.DataFrame({"at": pd.to_datetime([now], unit="ms"), "event_id": [ident], "hash": [content]})
        for out in step.handleInputRows((key,), iter([frame]), clock):
            told.extend((now, r.event_id, r.change, r.n) for r in out.itertuples())
    until(10**9)
    return told


def test_timers_wait_until_a_path_is_quiet():
    assert driven([(0, 1, "x"), (500, 2, "y"), (900, 3, "z")], 2.0) == [(2900, 3, "created", 3)]
    assert driven([(0, 1, "x"), (3000, 2, "x"), (9000, 3, "y"), (12000, 4, None)], 2.0) == [(2000, 1, "created", 1), (11000, 3, "modified", 1), (14000, 4, "deleted", 1)]
    # gone and back within the wait: nothing has changed
    assert driven([(0, 1, "x"), (5000, 2, None), (6000, 3, "x")], 2.0) == [(2000, 1, "created", 1)]
    # five seconds for all paths
    assert driven([(0, 1, "a:x"), (4000, 2, "b:y"), (8000, 3, "a:z")], 5.0, "*") == [(13000, 3, "created", 3)]


def test_a_path_that_tells_nothing_has_no_frame():
    step = stateful.LastOfBurst(2.0, "processing")
    step.init(Handle())
    frame = pd.DataFrame({"at": pd.to_datetime([0], unit="ms"), "event_id": [1], "hash": ["x"]})
    assert list(step.handleInputRows(("p",), iter([frame]), Clock())) == []
    assert [len(f) for f in step.handleExpiredTimer(("p",), Clock(), None)] == [1]


def test_a_larger_table_is_copied_by_more_tasks(spark, sf, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(streams, "folder", lambda s, name: made.append(f"{tmp_path}/{name}{len(made)}") or made[-1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "24KB")
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    try:
        copied, batches = streams._copied(spark, sf, "documents", 2), []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    copied.writeStream.foreachBatch(lambda b, n: batches.append((b.select(F.input_file_name()).distinct().count(), b.count()))).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    assert len(batches) == 2 and all(files > 2 for files, _ in batches) and sum(n for _, n in batches) == rows.count()
    assert max(r["n"] for r in spark.read.parquet(made[0]).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()) < rows.count() / 4


def test_all_paths_are_quiet_together(spark, tmp_path):
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s, timezone.utc).replace(tzinfo=None)
    path, schema = str(tmp_path / "in"), "path string, event_id long, at timestamp, hash string"
    for rows in ([("a", 1, at(0), "x"), ("b", 2, at(4), "y")], [("a", 3, at(8), "z"), ("b", 4, at(30), "q")], [("c", 5, at(31), None), ("a", 6, at(99), "w")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = lambda: tail.source(spark, path, T._parse_datatype_string(schema), 1)
    got = sorted((r["path"], r["event_id"], r["n"]) for r in tail.drain(stateful.last_of_burst(stream(), 5.0, together=True), "t").collect())
    assert got == [("*", 3, 3), ("*", 5, 2)]
    each = sorted((r["path"], r["event_id"], r["change"]) for r in tail.drain(stateful.last_of_burst(stream(), 5.0), "e").collect())
    assert each == [("a", 1, "created"), ("a", 3, "modified"), ("b", 2, "created"), ("b", 4, "modified")]
