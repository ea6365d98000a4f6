"""Matrix parts, scorers of pairs that fail, and measures of rows that flow."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from tidemark.operators import search, stages
from tidemark.plans import streams
from tidemark.sources import files


def test_a_matrix_is_written_where_its_rows_belong(spark, tmp_path, monkeypatch):
    v = np.random.default_rng(1).normal(size=(500, 6)).astype("<f4")
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row long, v array<float>").repartition(7)
    assert files.write_matrix(rows, f"file://{tmp_path}/m.npy", "row", "v", 6) == 500
    np.save(tmp_path / "by-numpy.npy", v)
    assert (tmp_path / "m.npy").read_bytes() == (tmp_path / "by-numpy.npy").read_bytes()
    # a store without positioned writes has parts
    monkeypatch.setattr(fs, "LocalFileSystem", type(None))
    assert files.write_matrix(rows, f"file://{tmp_path}/p.npy", "row", "v", 6) == 500
    monkeypatch.undo()
    assert (tmp_path / "p.npy.parts/manifest.json").exists() and not (tmp_path / "p.npy").exists()
    for name in ("m", "p"):
        got = {r["row"]: r["v"] for r in files.read_matrix(spark, f"file://{tmp_path}/{name}.npy", parts=5).collect()}
        assert len(got) == 500 and all(got[i] == x.tolist() for i, x in enumerate(v))
    with pytest.raises(ValueError):
        files.write_matrix(rows.where("row <> 3"), f"file://{tmp_path}/q.npy", "row", "v", 6)
    with pytest.raises(Exception, match="repeat or lack"):
        files.write_matrix(rows.where("row <> 3").unionByName(rows.where("row = 4")), f"file://{tmp_path}/q.npy", "row", "v", 6)
    assert files.write_matrix(rows.limit(0), f"file://{tmp_path}/e.npy", "row", "v", 6) == 0 and files.read_matrix(spark, f"file://{tmp_path}/e.npy").count() == 0


def test_reranking_falls_back_to_the_old_order(spark, tmp_path):
    rows = [(q, r, r, f"q{q}", "bad" if (q, r) == (2, 5) else "x" * (r * 7 % 11)) for q in (1, 2, 3) for r in range(1, 9)]
    df = spark.createDataFrame(rows, "query_id long, row_id long, rank long, query string, text string").coalesce(1)

    def load():
        def model(pairs):
            with open(tmp_path / "calls", "a") as f:
                f.write(f"{len(pairs)}\n")
            if any(t == "bad" for _, t in pairs):
                raise RuntimeError("a pair that fails")
            return [len(t) for _, t in pairs]

        return model

    got = search.rerank(df, load, 5, batch=4).collect()
    by = {q: [(r["row_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (1, 2, 3)}
    best = sorted(range(1, 9), key=lambda r: (-(r * 7 % 11), r))[:5]
    assert [r for r, _ in by[1]] == [r for r, _ in by[3]] == best and by[2] == [(r, None) for r in range(1, 6)]
    assert max(int(x) for x in (tmp_path / "calls").read_text().split()) == 4

    def broken():
        raise OSError("no model here")

    assert [r["row_id"] for r in search.rerank(df.where("query_id = 1"), broken, 3).orderBy("rank").collect()] == [1, 2, 3]
    assert search.rerank(df, lambda: lambda pairs: [1.0], 3, batch=2).where("score IS NOT NULL").count() == 0


def test_measures_of_rows_arrive_in_a_sink(spark, tmp_path):
    seen = []
    measures = {"rows": ("counter", F.count(F.lit(1))), "slowest": ("timing", F.max("ms")), "last": ("gauge", F.max_by("ms", "id"))}
    meter = stages.Meter(lambda *x: seen.append(x), measures, {"stage": "s"})
    rows = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 7.0)], "id long, ms double")
    assert meter.batch(rows).where("ms > 5").count() == 2
    meter.report()
    assert seen == [("counter", "rows", 3.0, {"stage": "s"}), ("timing", "slowest", 9.0, {"stage": "s"}), ("gauge", "last", 7.0, {"stage": "s"})]
    with pytest.raises(ValueError):
        stages.Meter(print, {"x": ("other", F.count(F.lit(1)))})
    seen.clear()
    for k in range(2):
        rows.limit(k + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    listener = meter.listener()
    spark.streams.addListener(listener)
    try:
        stream = meter.stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
        until = time.time() + 20
        while sum(x[1] == "rows" for x in seen) < 2 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [(x[2], x[3]) for x in seen if x[1] == "rows"] == [(1.0, {"stage": "s", "batch": "0"}), (2.0, {"stage": "s", "batch": "1"})]


def test_a_search_holds_few_scores_at_once(spark):
    def counted(qv, xv):
        assert qv.shape[0] * xv.shape[0] <= 1 << 19
        return -np.abs(qv[:, 0][:, None] - xv[:, 0][None])

    search.register_metric("counted", counted)
    rows = spark.range(3000).repartition(1).select("id", F.array(F.col("id").cast("double")).alias("v"))
    found = search.top_k(rows.where("id < 600"), rows, 1, "counted").collect()
    del search.METRICS["counted"]
    assert sorted((r["query_id"], r["row_id"]) for r in found) == [(k, k) for k in range(600)]


def test_a_copied_table_has_files_by_its_bytes(spark, tmp_path, monkeypatch):
    spark.range(50_000).repartition(1).write.parquet(str(tmp_path / "t.parquet"))
    size = sum(p.stat().st_size for p in (tmp_path / "t.parquet").glob("*.parquet"))
    monkeypatch.setattr(streams, "FILE_BYTES", size // 30, raising=False)
    monkeypatch.setattr(streams, "folder", lambda s, name: str(tmp_path / "copy"))
    streams._copied(spark, str(tmp_path), "t", 3)
    assert len(list((tmp_path / "copy").glob("*.parquet"))) >= 30
