"""Nested documents, contracts, embedding backends and stores."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import validation
from tidemark.operators import documents, embedding
from tidemark.sources import files, store


def nested(**more):
    base = {
        "Title": "A title", "Short Title": "A", "Overall Purpose": "To test. To test again.", "Why This Matters": "It does.", "When To Use This Protocol": "Now.",
        "Overall Outcomes": {"Poor": "p", "Expected": "e", "Excellent": "x", "Transcendent": "t"},
        "Themes": [{"Name": "One", "Purpose of This Theme": "First.", "Why This Matters": "So.", "Guiding Questions": ["Why?", "How?"], "Outcomes": {"Poor": {"Present pattern": "pp", "Signals": "si"}, "Expected": {"Future effect": "fe"}}}],
        "Completion Prompts": ["Done?"], "Protocol ID": "a_title", "Metadata": {"Tags": ["x", "y"]},
    }
    return json.dumps({k: v for k, v in (base | more).items() if v is not None})


@pytest.fixture
def docs(spark):
    rows = [(nested(),), (nested(Title=None, **{"Protocol ID": "b"}),), (nested(Themes=[], **{"Protocol ID": "c"}),)]
    return spark.createDataFrame(rows, "raw string").select(F.from_json("raw", schemas.DOCUMENT).alias("d")).select("d.*")


def test_sections_in_order(docs):
    found = documents.sections(docs.where("`Protocol ID` = 'a_title'")).orderBy("section").collect()
    assert [r["name"] for r in found] == ["Title", "Short Title", "Overall Purpose", "Why This Matters", "When To Use This Protocol", "Overall Outcomes", "Theme 1: One", "Completion Prompts", "Tags"]
    assert found[0]["text"] == "Title: A title" and found[5]["text"] == "Overall Outcomes:\nPoor: p\nExpected: e\nExcellent: x\nTranscendent: t"
    assert found[6]["text"] == "Theme: One\nPurpose: First.\nWhy This Matters: So.\n\nOutcomes:\nPoor:\n  Present pattern: pp\n  Signals: si\n\nExpected:\n  Future effect: fe\n\nGuiding Questions:\n1. Why?\n2. How?"
    assert found[7]["text"] == "Completion Prompts:\n- Done?" and found[8]["text"] == "Tags:\n- x\n- y"


def test_profiles_quarantine(docs):
    chunks, bad = documents.profile(docs, "accuracy")
    assert {r["doc_id"] for r in chunks.collect()} == {"a_title"}
    assert {r["Protocol ID"]: r["errors"] for r in bad.collect()} == {"b": ["`Title` is required"], "c": ["`Themes` is shorter than 1"]}
    chunks, bad = documents.profile(docs, "speed")
    assert bad is None and {r["doc_id"] for r in chunks.collect()} == {"a_title", "b", "c"}
    first = chunks.where("chunk_id = 'a_title::s2::c0'").first()
    assert (first["text"], first["n_tokens"]) == ("Overall Purpose: To test. To test again.", 10)


@pytest.mark.parametrize(("row", "wrong"), [
    (("1.0", "abcdefgh", "q", "latency", 5, None, None, 64), []),
    (("1.0", "short", "", "fast", 11, None, None, 63), ["trace_id is shorter than 8", "query is shorter than 1", "mode is none of latency, accuracy", "top_k is above 10", "max_chunk_tokens is below 64"]),
    ((None, None, None, None, None, None, None, None), ["trace_id is required", "query is required", "mode is required", "top_k is required"]),
])
def test_request_contract(spark, row, wrong):
    assert validation.errors(spark.createDataFrame([row], schemas.REQUEST), schemas.REQUEST_RULES).first()["errors"] == wrong


def test_closed_schema_and_decline(spark):
    df = spark.createDataFrame([('{"a":1,"z":2}', 0)], "j string, n int")
    r = df.select(validation.unknown_keys(F.col("j"), ["a"]).alias("u"), validation.decline((F.col("n") == 0, "x", "m"), (F.col("n") > 0, "low", "n is low")).alias("d")).first()
    assert r["u"] == ["z"] and (r["d"]["reason"], r["d"]["message"]) == ("low", "n is low")


def test_embedding_backends(spark):
    df = spark.createDataFrame([("a",), (None,)], "text string")
    found = embedding.embed(df, "stub", 8).collect()
    assert sum(x * x for x in found[0]["v"]) == pytest.approx(1) and found[1]["v"] == [0.0] * 8
    embedding.register("bad", lambda text, dim: F.array(F.lit(1.0)))
    with pytest.raises(Exception, match="dimensions"):
        embedding.embed(df, "bad", 8).collect()


def test_stores(spark):
    kv = store.KeyValues(spark, files.folder(spark, "kv"))
    kv.put(spark.createDataFrame([("b", "k", "1"), ("c", "k", "9")], "bucket string, key string, value string"), 1)
    kv.put(spark.createDataFrame([("b", "k", "2")], "bucket string, key string, value string"), 2)
    assert [tuple(r) for r in kv.get("b").collect()] == [("k", "2")]
    wanted = spark.createDataFrame([("b", "k"), ("b", "x")], "bucket string, key string")
    assert kv.existing(wanted).count() == 1
    assert kv.compact() == 2 and kv.compact() == 0 and [tuple(r) for r in kv.get("b").collect()] == [("k", "2")] and kv.existing(wanted).count() == 1
    kv.put(spark.createDataFrame([("b", "k", "3")], "bucket string, key string, value string"), 3)
    assert [tuple(r) for r in kv.get("b").collect()] == [("k", "3")] and [tuple(r) for r in kv.get("c").collect()] == [("k", "9")] and kv.get("none").count() == 0
    p, df = store.Pointer(spark, files.folder(spark, "pointer")), spark.range(3)
    assert p.current() is None
    p.replace(df)
    p.replace(spark.range(5))
    assert p.read(df.schema).count() == 5
