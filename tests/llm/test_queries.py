"""The registered queries of the llm operators against SQL where there is some, and the pipeline's stages."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, queries
from tidemark.llm.common import Workspace


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    df = queries.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    done = con.execute(queries.ORACLE_SQL[name])
    have = [c[0] for c in done.description]
    assert sorted(have) == names
    at = [have.index(c) for c in names]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in done.fetchall())))


@pytest.mark.parametrize("name", ["op1_mixing", "op2_neardup", "op3_fingerprints", "op5_quality", "op6_media", "op9_pieces"])
def test_a_row_for_each_document(spark, sf, name):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert queries.QUERIES[name](spark, sf).select("doc_id").distinct().count() == n


def test_pipeline(spark, sf):
    docs, work = spark.read.parquet(f"{sf}/documents.parquet"), Workspace(spark, "t")
    columns, labels = docs.columns, spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    ids = [{r["doc_id"] for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf), name.replace(" ", "-"))
        assert docs.columns == columns
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
    assert len(ids[1] & good) >= 0.95 * len(good) and len(ids[1]) < len(ids[0]) and ids[2] == ids[1] and len(ids[3]) < len(ids[2])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count() and last.where("NOT lossless").count() == 0


def test_pipeline_of_an_empty_table(spark, sf):
    docs, work = spark.read.parquet(f"{sf}/documents.parquet").limit(0), Workspace(spark, "t")
    for name, stage in corpus_pipeline.STAGES:
        docs = work.write(stage(spark, docs, sf), name.replace(" ", "-"))
    assert docs.count() == 0


def test_a_run_of_the_pipeline_leaves_one_table(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() > 0 and rows.columns == ["doc_id", "lang", "source", "n_chars", "pieces", "lossless"]
    assert [p.name for p in tmp_path.glob("*/*")] == ["004-mixing-sources-to-target-weights"]


def test_stages_take_columns_of_clashing_names(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for c in ("score", "copies", "rate", "kept", "hash", "th", "pieces", "component_id", "lines_removed"):
        docs = docs.withColumn(c, F.lit("clash"))
    work = Workspace(spark, "t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = work.write(stage(spark, docs, sf), name.replace(" ", "-"))
        assert set(docs.columns) - set(after.columns) <= {"lines_removed"}
        assert after.select("score", "copies", "hash").distinct().collect() == [("clash", "clash", "clash")]
        docs = after
