"""Functions and operators against plain Python on small rows."""

from __future__ import annotations

import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import chunk, text
from tidemark.operators import evaluation, search, sessions
from tidemark.sources import files


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


def test_redaction_keeps_and_hides(spark):
    cases = {
        "write to ann.lee@example.org now": "write to [EMAIL_REDACTED] now",
        "call (555) 123-4567 or 555-123-4567": "call [PHONE_REDACTED] or [PHONE_REDACTED]",
        "build 2024.10.3 of 12-34": "build 2024.10.3 of 12-34",
        "see https://x.org/a?b=c ok": "see [URL_REDACTED] ok",
        "key AbCd1234AbCd1234AbCd1234": "key [API_KEY_REDACTED]",
        "ssn 123-45-6789 but 000-45-6789": "ssn [SSN_REDACTED] but 000-45-6789",
    }
    for raw, wanted in cases.items():
        assert one(spark, text.redact(F.col("t")), t=raw) == wanted


def test_redaction_equals_python(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", text.redact(F.col("text")).alias("r")).collect()
    for r in rows:
        t = r["text"]
        for _, pattern, put in text.REDACTIONS:
            t = re.sub(pattern, put, t)
        assert t == r["r"]


def test_redaction_ends_words_at_accents_as_sql_does(spark):
    key = "AbCd1234AbCd1234AbCd1234"
    for raw in (f"é{key}", f"{key}é", f"Größe{key}ß and ü{key}", f"_{key}", f"{key}_", f"x{key}é_", "é555-123-4567ü", "éann@example.orgé", "ü123-45-6789é", "é4111 1111 1111 1111ü"):
        for name, pattern, put in text.REDACTIONS:
            if name != "ssn":
                assert one(spark, text.redact(F.col("t"), name), t=raw) == duckdb.execute("SELECT regexp_replace(?, ?, ?, 'g')", [raw, pattern, put]).fetchone()[0], (raw, name)
    assert one(spark, text.redact(F.col("t"), "ssn"), t="ü123-45-6789é") == "ü[SSN_REDACTED]é"


def test_slugs(spark):
    assert one(spark, text.slug_hyphen(F.col("t")), t="  Hello, World -- 2! ") == "hello-world-2"
    assert one(spark, text.slug_snake(F.col("t")), t="Élan vital -- Über") == "elan_vital_uber"
    assert one(spark, text.is_clean_slug(F.col("t")), t="auto_12") is False
    assert one(spark, text.safe_filename(F.col("t")), t="A b//c.txt ") == "a_b_c.txt"


def test_greedy_chunks_equal_python(spark, sf):
    def python(t, most, overlap):
        size = lambda s: len(s) // 4
        sents = [s.strip(" ") for s in re.split(r"(?<=[.!?])\s+", t) if s.strip(" ")]
        done, held = [], []
        for s in sents:
            if held and sum(map(size, held)) + size(s) > most:
                done.append(held)
                kept, n = [], 0
                for x in reversed(held):
                    if n + size(x) > overlap:
                        break
                    kept.insert(0, x)
                    n += size(x)
                held = [*kept, s]
            else:
                held = [*held, s]
        return [*done, held] if held else done

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", chunk.greedy_chunks(F.col("text"), 60, 20).alias("c")).collect()
    for r in rows:
        assert [list(c) for c in r["c"]] == python(r["text"], 60, 20)


def test_windows_end_with_the_text(spark):
    t = " ".join(map(str, range(1000)))
    found = one(spark, chunk.fixed_windows(F.col("t")), t=t)
    assert [(w["start"], w["stop"]) for w in found] == [(0, 500), (450, 950), (900, 1000)]
    assert one(spark, chunk.fixed_windows(F.col("t")), t="") == []


def test_zero_query_finds_least_ids(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, v array<double>")
    zero = spark.createDataFrame([(99, [0.0, 0.0])], "id long, v array<double>")
    found = search.top_k(zero, rows, 3).orderBy("rank").collect()
    assert [(r["row_id"], r["score"]) for r in found] == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_search_equals_brute_force_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search, "ROW_BLOCK", 7)
    rng = np.random.default_rng(0)
    m = rng.normal(size=(40, 5))
    rows = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(m)], "id long, v array<double>")
    found = {(r["query_id"], r["rank"]): r["row_id"] for r in search.top_k(rows, rows, 4, "dot").collect()}
    for q in range(40):
        s = np.round(m @ m[q], 6)
        assert [found[q, k + 1] for k in range(4)] == sorted(range(40), key=lambda i: (-s[i], i))[:4]


def test_metrics_quirks(spark):
    ranked = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 1)], "query_id string, doc_id long, rank long")
    gold = spark.createDataFrame([("a", 2), ("a", 9)], "query_id string, doc_id long")
    m = {r["query_id"]: r for r in evaluation.metrics(evaluation.judged(ranked, gold), 10).collect()}
    assert (m["a"]["precision"], m["a"]["recall"], m["a"]["rr"], m["a"]["ndcg"], m["a"]["coverage"]) == (0.333333, 0.5, 0.5, 0.5, True)
    assert (m["b"]["recall"], m["b"]["ndcg"], m["b"]["coverage"]) == (0.0, 0.0, True)


def test_stop_rule_and_first_failure(spark):
    rows = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, False), (2, 0, False)], "s long, t long, bad boolean")
    assert [(r["s"], r["t"]) for r in sessions.until_first(rows, ["s"], ["t"], F.col("bad")).orderBy("s", "t").collect()] == [(1, 0), (1, 1), (2, 0)]
    assert one(spark, sessions.first_failure(("x", F.col("a") > 0), ("y", F.col("b") > 0)), a=1, b=0) == "y"


def test_fusion_keeps_both_ranks(spark):
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "query_id long, row_id long, score double, rank long")
    b = spark.createDataFrame([(1, 11, 0.7, 1)], "query_id long, row_id long, score double, rank long")
    found = search.reciprocal_rank_fusion(a, b, 5).orderBy("rank").collect()
    assert [(r["row_id"], r["rank_a"], r["rank_b"]) for r in found] == [(11, 2, 1), (10, 1, None)]


def test_mmr_prefers_what_is_new(spark):
    c = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.0]), (1, 3, 0.6, [0.0, 1.0])], "query_id long, row_id long, score double, v array<double>")
    assert [r["row_id"] for r in search.mmr(c, 3, 0.5).orderBy("pick").collect()] == [1, 3, 2]



def test_readers(spark):
    rows = spark.createDataFrame([(1, "a"), (2, 'b"}{')], "id long, t string")
    path = files.write_jsonl(rows, spark, "t")
    assert files.read_jsonl(spark, path, rows.schema).count() == 2
    assert files.find_files(spark, path, "*.json").count() >= 1
    assert files.find_files(spark, f"{path}-missing").count() == 0
    assert files.read_yaml(spark, "- {slug: a, name: A}\n- {slug: b}", files.T.StructType([files.T.StructField("slug", files.T.StringType()), files.T.StructField("name", files.T.StringType())])).count() == 2
    split = files.split_objects(spark.createDataFrame([(1, '{"a":"}{"}{"b":{"c":"\\"}"}}'), (2, None)], "id long, raw string"), "raw").collect()
    assert [r["object"] for r in split] == ['{"a":"}{"}', '{"b":{"c":"\\"}"}}']


def test_numbers_and_sliding_windows_over_blocks(spark):
    from tidemark.operators.ordered import numbered, sliding

    rows = spark.createDataFrame([("a" if i % 3 else "b", (i * 37) % 101, float(i)) for i in range(101)], "k string, o long, v double")
    got = sliding(numbered(rows, ["k"], ["o"]), ["k"], "nth", 9, F.max("v"), "top", block=4).collect()
    assert len(got) == 101
    for key in "ab":
        mine = sorted((r for r in rows.collect() if r["k"] == key), key=lambda r: r["o"])
        have = sorted((r for r in got if r["k"] == key), key=lambda r: r["nth"])
        assert [r["nth"] for r in have] == list(range(1, len(mine) + 1)) and [r["o"] for r in have] == [r["o"] for r in mine]
        assert [r["top"] for r in have] == [max(r["v"] for r in mine[max(0, i - 8) : i + 1]) for i in range(len(mine))]
