"""Selection, percentiles by rank, stages, sources and streams against plain Python."""

from __future__ import annotations

import json
import random
from collections import Counter
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import curation, embedding, ordered, reindex, search, stages
from tidemark.sources import files, paths, store
from tidemark.streaming import stateful, tail

C = F.col
ROW = "id long, slug string, stage string, bucket string, tokens long, tags array<string>, fields array<string>"


def select_plainly(rows, q):
    """The whole selection over the list of all rows, one step after the other."""
    rows = sorted(rows, key=lambda r: r["id"])
    taken, fields = [], set()
    count = lambda key, value: sum(r[key] == value for r in taken)
    cover = lambda t: sum(t in r["tags"] for r in taken)

    def score(r):
        points = {"long": 200, "medium": 100, "short": 50}[r["bucket"]] if count("bucket", r["bucket"]) < q.lengths.get(r["bucket"], 0) else 0
        return min(len(set(r["tags"])), 3) * 1000 + 500 * sum(f in q.fields and f not in fields for f in set(r["fields"])) + points + 300 * sum(t in q.tags and cover(t) < 2 for t in set(r["tags"]))

    def best(found, penalised):
        late = lambda r: 100 * (penalised and count("bucket", r["bucket"]) >= q.lengths.get(r["bucket"], 0))
        if q.lowest_first:
            key = max((-score(r) - late(r), r["slug"]) for r in found)
            return next(r for r in found if (-score(r) - late(r), r["slug"]) == key)
        return min(found, key=lambda r: (late(r) - score(r), r["slug"], r["id"]))

    def take(r):
        taken.append(r)
        fields.update(r["fields"])

    for r in rows:
        if r["id"] in q.includes:
            take(r)
    while len(taken) < q.total and (fits := [r for r in rows if r not in taken and count("stage", r["stage"]) < q.stages.get(r["stage"], 0)]):
        take(best(fits, True))
    for t in sorted(q.tags):
        if cover(t) < 2 and (having := [r for r in rows if r not in taken and t in r["tags"]]):
            new = best(having, False)
            if taken:
                taken.pop()
            take(new)
    for t in [t for t in sorted(q.tags) if not cover(t)][: q.swaps]:
        if having := [r for r in rows if r not in taken and t in r["tags"]]:
            known = lambda r: set(r["tags"]) & set(q.tags)
            new = min(having, key=lambda r: (-len(known(r)), r["tokens"], r["id"]))
            spare = [r for r in taken if all(cover(x) > 1 for x in known(r))]
            old = min(spare, key=lambda r: (-sum(map(cover, known(r))), -r["tokens"], r["id"])) if spare else min(taken, key=lambda r: (-r["tokens"], r["id"]))
            taken.remove(old)
            take(new)
    return [r["id"] for r in taken]


@pytest.mark.parametrize("lowest", [False, True])
def test_selection_equals_plain_python_over_all_documents(spark, lowest):
    rng = random.Random(7)
    tags, fields = tuple("abcdefgh"), tuple("uvw")
    for seed in range(3):
        rows = [{"id": i, "slug": f"s{rng.randrange(30)}", "stage": rng.choice(["x", "y", "z"]), "bucket": rng.choice(["short", "medium", "long"]), "tokens": rng.randrange(50), "tags": rng.sample([*tags[: 6 + seed % 2], "other"], rng.randrange(3)) + (["h"] if i == 77 else []), "fields": rng.sample([*fields, "q"], rng.randrange(3))} for i in range(200)]
        q = curation.Quotas(10, {"x": 4, "y": 3, "z": 3}, {"short": 2, "medium": 3, "long": 5}, tags, fields, includes=(5, 9), lowest_first=lowest)
        found = curation.select_balanced(spark.createDataFrame([tuple(r.values()) for r in rows], ROW), q).orderBy("pick").collect()
        assert [r["id"] for r in found] == select_plainly(rows, q)
    hows = Counter(r["how"] for r in found)
    assert hows["included"] + hows["picked"] + hows["covers"] + hows["swapped"] == 10


def test_selection_by_rounds_of_all_different_kinds(spark, monkeypatch):
    """Ten tags and eight fields, of which nearly each document has a set of its own; rounds of a few rows."""
    monkeypatch.setattr(curation, "ROUND", 4)
    rng = random.Random(8)
    tags, fields = tuple(f"t{k}" for k in range(10)), tuple(f"f{k}" for k in range(8))
    rows = [{"id": i, "slug": f"s{rng.randrange(100)}", "stage": rng.choice("xyz"), "bucket": rng.choice(["short", "medium", "long"]), "tokens": rng.randrange(50), "tags": rng.sample(tags[: 9 if i else 10], rng.randrange(6)), "fields": rng.sample(fields, rng.randrange(6))} for i in range(400)]
    q = curation.Quotas(15, {"x": 6, "y": 5, "z": 5}, {"short": 4, "medium": 5, "long": 6}, tags, fields)
    found = curation.select_balanced(spark.createDataFrame([tuple(r.values()) for r in rows], ROW), q).orderBy("pick").collect()
    assert [r["id"] for r in found] == select_plainly(rows, q) and len(found) == 15
    assert curation.select_balanced(spark.createDataFrame([], ROW), q).count() == 0


@pytest.mark.parametrize("nearest", [False, True])
def test_percentiles_by_rank_equal_numpy(spark, nearest):
    rng = random.Random(8)
    rows = [(rng.choice("aab"), rng.choice([None, float(rng.randrange(40)), rng.random()])) for _ in range(700)] + [("c", 1.5), ("d", None)]
    found = {r["k"]: r["p"] for r in ordered.percentile(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", 0.95, "p", nearest).collect()}
    assert set(found) == set("abc")
    for k, p in found.items():
        values = sorted(v for x, v in rows if x == k and v is not None)
        assert p == pytest.approx(values[int(np.ceil(0.95 * len(values))) - 1] if nearest else np.percentile(values, 95))


def test_percentiles_of_ties_nulls_and_extremes(spark):
    rng = np.random.default_rng(6)
    rows = [(k, float(v)) for k, n in (("a", 3000), ("b", 1), ("c", 2), (None, 50)) for v in np.where(rng.random(n) < 0.6, 0.0, rng.normal(size=n))] + [("d", None), ("a", None), ("e", float("inf")), ("e", -1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    for share in (0.0, 0.3, 0.5, 0.95, 1.0):
        for nearest in (True, False):
            found = {r["k"]: r["p"] for r in ordered.percentile(df, ["k"], "v", share, "p", nearest, accuracy=100).collect()}
            assert set(found) == set(by)
            for k, v in by.items():
                if not nearest and k == "e":
                    continue
                assert found[k] == pytest.approx(sorted(v)[max(1, int(np.ceil(share * len(v)))) - 1] if nearest else np.percentile(v, 100 * share), abs=1e-12)


def test_window_percentiles_of_any_length():
    rng = np.random.default_rng(7)
    for n, last in ((1, 1), (50, 1), (500, 7), (60_000, 20_000)):
        v = np.where(rng.random(n) < 0.1, np.nan, rng.choice([*rng.normal(size=300), 0.0, 0.0], n))
        found = ordered.window_percentiles(v, last, 0.95)
        for i in (range(n) if n < 1000 else rng.integers(0, n, 40)):
            seen = v[max(0, i - last + 1) : i + 1]
            seen = seen[~np.isnan(seen)]
            assert np.isnan(found[i]) if not len(seen) else found[i] == pytest.approx(np.percentile(seen, 95))


def test_sessions_across_ranges(spark):
    rng = random.Random(8)
    rows, t = [], 0
    for k in range(3000):
        t += rng.choice([1, 5, 29, 30, 31, 90])
        rows.append((rng.choice([1, 1, 1, 2, None]), t, k))
    df = spark.createDataFrame(rows, "u int, m int, id int").withColumn("ts", F.timestamp_seconds(F.col("m") * 60))
    found = {r["id"]: r["session"] for r in ordered.sessions(df, ["u"], ["ts", "id"], "ts", "30 MINUTES").collect()}
    last, number = {}, {}
    for u, m, k in rows:
        number[u] = number.get(u, 0) + (u not in last or m - last[u] > 30)
        last[u] = m
        assert found[k] == number[u]


def test_scratch_removes_what_is_made_inside(spark, tmp_path):
    with files.scratch(spark):
        path = files.write_jsonl(spark.range(3), spark, "gone")
        assert spark.read.json(path).count() == 3
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def test_sliding_percentiles_equal_numpy(spark):
    rng = random.Random(10)
    rows = [(k, i + 1, None if rng.random() < 0.2 else float(rng.randrange(30))) for k in "ab" for i in range(130)] + [("c", 1, None), ("d", 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, nth long, v double").repartition(3)
    found = {(r["k"], r["nth"]): r["p"] for r in ordered.sliding_percentile(df, ["k"], "nth", 9, "v", 0.95, "p", block=20).collect()}
    assert len(found) == len(rows)
    for k, i, _ in rows:
        seen = [v for q, j, v in rows if q == k and i - 9 < j <= i and v is not None]
        assert found[k, i] == (pytest.approx(np.percentile(seen, 95)) if seen else None)


def test_vector_search_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "ROW_BLOCK", 16)
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(1)
    v, label = rng.normal(size=(90, 5)).round(1), rng.integers(0, 4, 90)
    v[7] = 0
    rows = spark.createDataFrame([(i, x.tolist(), None if i % 30 == 3 else int(g)) for i, (x, g) in enumerate(zip(v, label))], "id long, v array<double>, label int").repartition(3)
    asked = rows.where("id % 5 = 2")
    for metric, same in (("cosine", None), ("dot", "label"), ("l2", "label"), ("cosine", "label")):
        found = {}
        for r in search.top_k(asked, rows, 4, metric, same).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["row_id"])
        unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        s = np.round(unit @ unit.T if metric == "cosine" else v @ v.T if metric == "dot" else -np.linalg.norm(v[:, None] - v[None], axis=2), 6) + 0.0
        for q in range(2, 90, 5):
            ok = [i for i in range(90) if same is None or (label[i] == label[q] and i % 30 != 3 and q % 30 != 3)]
            assert found.get(q, []) == sorted(ok, key=lambda i: (-s[q, i], i))[:4]
    search.register_metric("manhattan", lambda a, b: -np.abs(a[:, None] - b[None]).sum(2))
    assert search.top_k(asked, rows, 1, "manhattan").where("query_id = row_id").count() == 18


def test_modes_route_to_indexes(spark):
    a, b = spark.range(1), spark.range(2)
    assert search.routed("accuracy", {"latency": a, "accuracy": b}) == (b, []) and search.routed("nonsense", {"latency": a, "accuracy": b}) == (a, [])
    assert search.routed("accuracy", {"latency": a}) == (a, ["Accuracy index not available, using latency index"]) and search.routed(None, {"latency": a}) == (a, [])


def test_stages_policies_and_ports(spark):
    known = stages.Stages()
    for k, name in enumerate("abcd"):
        known.register(name, lambda df, k=k: df.withColumn(f"c{k}", F.lit(k)))
    assert known.plan(("d", "b"), mini=True) == ["b", "d"] and known.plan(mini=True) == list("abc") and not known.available("z")
    assert known.run(spark.range(1), ["c", "a"]).columns == ["id", "c2", "c0"] and len(known.run(spark.range(1)).columns) == 5
    for bad in (lambda: known.get("z"), lambda: known.register("a", None)):
        with pytest.raises((KeyError, ValueError)):
            bad()
    rows = spark.createDataFrame([("one\ntwo", "NOW", "yes"), ("x", "SOON", "YES"), ("y", "NOW", None)], "text string, pace string, consent string")
    got = stages.Policies().apply(rows).collect()
    assert [(r["pace_state"], r["consent_state"], r["display_text"]) for r in got] == [("NOW", "YES", "one\ntwo [[COMPLETE]]"), ("HOLD", "YES", "x"), ("NOW", "HOLD", "y")]
    assert got[0]["reflected"] == ["one", "two"] and got[0]["diagnostics"]["words"] == 2
    louder = stages.Policies(completion=lambda t: F.upper(t)).apply(rows, diagnostics=False).collect()
    assert louder[0]["display_text"] == "ONE\nTWO" and louder[0]["diagnostics"] is None
    seen = []
    ports = stages.Ports(lambda: datetime(2024, 1, 1), lambda: "run-1", lambda *x: seen.append(x))
    assert ports.stamped(spark.range(2)).select("run_id", "run_at").distinct().collect() == [("run-1", datetime(2024, 1, 1))] and seen == [("runs", 1, {"run": "run-1"})]


def test_model_backends_batch_retry_and_fall_back(spark, tmp_path):
    marks = str(tmp_path)

    def load():
        import os

        def model(texts):
            with open(f"{marks}/calls-{os.getpid()}", "a") as f:
                f.write(f"{len(texts)}\n")
            if "bad" in texts:
                raise OSError("no answer")
            return [[float(len(t)), 1.0] for t in texts]

        return model

    embedding.register("lengths", embedding.model_backend(load, batch=2, retries=2, wait=0.01))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bbb", "cc", None, "dddd", "e", "bad"])], "i int, text string").coalesce(1)
    found = {r["i"]: r["v"] for r in embedding.embed(rows, "lengths", 2, unit=False).collect()}
    assert found == {0: [1.0, 1.0], 1: [3.0, 1.0], 2: [2.0, 1.0], 3: [0.0, 0.0], 4: [4.0, 1.0], 5: [1.0, 1.0], 6: [0.0, 0.0]}
    calls = [int(x) for f in tmp_path.iterdir() for x in f.read_text().split()]
    assert max(calls) == 2 and calls.count(1) == 3
    embedding.register("strict", embedding.model_backend(load, retries=0, fallback=False))
    with pytest.raises(Exception, match="no answer"):
        embedding.embed(rows, "strict", 2).collect()
    assert embedding.chosen_backend({}) == "stub" and embedding.chosen_backend({"RAG_REAL_EMBED": "1", "KEY": "k"}, "lengths", key="KEY") == "lengths"
    halves = [0.1, 1.0, -3.14159, 1e-6, 65504.0, 0.0, 2.0**-15 * 1.0004]
    got = spark.createDataFrame([(x,) for x in halves], "x double").select(embedding.half(C("x")).alias("h")).collect()
    assert [r["h"] for r in got] == [float(np.float16(x)) for x in halves]


def test_an_index_is_brought_up_to_date(spark):
    index = reindex.Index(spark, files.folder(spark, "index"), dim=4)
    row = lambda i, text: (i, text, f"{hash(text)}")
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, hash string")
    first = index.update(docs([row(1, "a b"), row(2, "c d e"), row(3, "f")])).first()
    assert (first["files_added"], first["chunks_before"], first["chunks_after"], first["tokens_after"]) == (3, 0, 3, 6)
    second = index.update(docs([row(1, "a b"), row(2, "c d e x"), row(4, "")])).first()
    assert (second["files_changed"], second["files_added"], second["files_removed"], second["tokens_before"], second["tokens_after"]) == (1, 1, 1, 6, 6)
    assert {(r["doc_id"], r["text"], len(r["v"])) for r in index.chunks().collect()} == {(1, "a b", 4), (2, "c d e x", 4)}
    with pytest.raises(store.Conflict):
        index._put("versions", index.number(), index.version())


def folder_bytes(path):
    return sum(f.stat().st_size for f in Path(path.removeprefix("file:").replace("//", "")).rglob("*.parquet"))


def test_an_update_writes_what_it_changes(spark, tmp_path):
    index = reindex.Index(spark, f"file://{tmp_path}/index", dim=64, fanout=100)
    docs = lambda ids, mark: spark.createDataFrame([(i, f"word{i} " * 300 + mark, f"{i}{mark}") for i in ids], "doc_id long, text string, hash string").coalesce(1)
    index.apply(docs(range(200), "a"))
    whole = folder_bytes(str(tmp_path))
    stats = index.apply(docs(range(3), "b"))
    assert folder_bytes(str(tmp_path)) - whole < 0.2 * whole
    assert (stats["files_changed"], stats["files_added"], stats["chunks_before"], stats["chunks_after"]) == (3, 0, 200, 200)
    assert index.apply(docs(range(3), "b"))["files_changed"] == 0 and len(index.version()["segments"]) == 2
    assert {r["hash"] for r in index.chunks().where("doc_id < 4").collect()} == {"0b", "1b", "2b", "3a"} and index.chunks().count() == 200
    assert index.chunks(1).where("hash LIKE '%b'").count() == 0


def test_segments_are_merged_and_batches_come_once(spark, tmp_path):
    index = reindex.Index(spark, f"file://{tmp_path}/index", dim=2, fanout=3)
    rng, truth = random.Random(3), {}
    for batch in range(9):
        rows = []
        for i in rng.sample(range(12), 4):
            text = None if rng.random() < 0.3 else f"t{batch} x{i}"
            rows.append((i, text, text))
            truth[i] = text
        df = spark.createDataFrame(rows, "doc_id long, text string, hash string").coalesce(1)
        assert index.apply(df, batch) is not None and index.apply(df, batch) is None
    live = {i: t for i, t in truth.items() if t is not None}
    assert {r["doc_id"]: r["text"] for r in index.chunks().collect()} == live and {r["doc_id"] for r in index.documents().collect()} == set(live)
    assert len(index.version()["segments"]) < 6 and index.version()["chunks"] == len(live)
    runs = index.runs()
    assert runs.count() == 9 and runs.where("success AND error IS NULL").count() == 9 and runs.agg(F.max("chunks_after")).first()[0] >= len(live)
    assert index.vacuum(grace=-5) > 0 and {r["doc_id"]: r["text"] for r in index.chunks().collect()} == live


def test_pointers_survive_writers_that_die(spark, tmp_path):
    p, df = store.Pointer(spark, f"file://{tmp_path}/pointer"), spark.range(3)
    p.replace(df)
    # one that died after its data, and one after its temporary file
    df.write.parquet(f"file://{tmp_path}/pointer/data/left")
    (tmp_path / "pointer/pointers/.left").write_text("")
    assert p.number() == 1 and p.replace(spark.range(5)) == 2 and p.read(df.schema).count() == 5
    with pytest.raises(store.Conflict):
        p.replace(df, base=1)
    assert p.read(df.schema).count() == 5 and p.vacuum() == 1 and p.vacuum(grace=-5) == 2 and p.read(df.schema).count() == 5


def test_changes_wait_and_deletions_count(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("pq"), 1_700_000_000 + i * rng.choice([1, 1, 3]), rng.choice(["x", "y", None])) for i in range(120)]
    rows = [(i, p, 1_700_000_000 + 1.5 * i, h) for i, p, _, h in rows]
    path = files.folder(spark, "changes")
    spark.createDataFrame(rows, "event_id long, path string, t double, hash string").coalesce(1).write.parquet(path)
    source = tail.source(spark, path, spark.read.parquet(path).schema).withColumn("at", F.col("t").cast("timestamp"))
    got = {(r["path"], r["event_id"], r["change"]) for r in tail.drain(stateful.first_of_burst(source, 2.0), "changes").collect()}
    wanted = set()
    for p in "pq":
        known = last = None
        for i, _, t, h in (r for r in rows if r[1] == p):
            if h is None:
                if known is not None:
                    wanted.add((p, i, "deleted"))
                known = None
            elif (last is None or t - last >= 2.0) and h != known:
                wanted.add((p, i, "created" if known is None else "modified"))
                known, last = h, t
    assert got == wanted and {c for _, _, c in got} == {"created", "modified", "deleted"}


def test_paths_and_required_files(spark, tmp_path):
    own = {"fast": {"path": "a/x.faiss", "meta": "m"}}
    assert paths.index_paths("fast", own, {}) == paths.IndexPaths("a/x.faiss", "m", ".vector/fast.stats.json", False)
    assert paths.index_paths("fast", own, {"VECTOR_PATH_FAST": "env"}).index == "env" and paths.index_paths("slow", own, {"VECTOR_PATH_SLOW": "e"}).meta == ".vector/slow.meta.jsonl"
    assert paths.index_paths("slow", {"path_or_index": "b/i.faiss"}, {}) == paths.IndexPaths("b/i.faiss", "b/meta.jsonl", "b/stats.json", True)
    (tmp_path / "index.faiss").write_text("x")
    assert paths.missing(spark, f"file://{tmp_path}", ("index.faiss", "metadata.parquet")) == ["metadata.parquet"]
    with pytest.raises(FileNotFoundError, match="metadata.parquet"):
        paths.require(spark, f"file://{tmp_path}", ("index.faiss", "metadata.parquet"))


def test_matrices_and_index_layouts(spark, tmp_path):
    v = np.arange(12, dtype=np.float32).reshape(4, 3)
    rows = spark.createDataFrame([(i, x.tolist(), f"d{i}") for i, x in enumerate(v)], "row long, v array<float>, doc string")
    meta = rows.select("doc").schema
    assert files.write_matrix(rows, f"file://{tmp_path}/a/vectors.npy", "row", "v", 3) == 4
    assert (np.load(tmp_path / "a/vectors.npy") == v).all()
    rows.select("row", "doc").unionByName(spark.createDataFrame([(None, "stray")], "row long, doc string")).write.json(f"file://{tmp_path}/a/meta.jsonl")
    files.write_matrix(rows, f"file://{tmp_path}/b/vectors.npy", "row", "v", 3)
    rows.select("row", "doc").write.parquet(f"file://{tmp_path}/b/metadata.parquet")
    rows.write.parquet(f"file://{tmp_path}/c")
    for layout in "abc":
        assert sorted((r["row"], tuple(r["v"]), r["doc"]) for r in files.load_index(spark, f"file://{tmp_path}/{layout}", meta).collect()) == [(i, tuple(x), f"d{i}") for i, x in enumerate(v.tolist())]
    with pytest.raises(ValueError, match="4 vectors but 3"):
        files.aligned(files.read_matrix(spark, f"file://{tmp_path}/a/vectors.npy"), rows.where("row < 3").select("row", "doc"))
    with pytest.raises(ValueError, match="3 rows from 1 to 3"):
        files.write_matrix(rows.where("row > 0"), f"file://{tmp_path}/d/vectors.npy", "row", "v", 3)


def test_records_files_by_document_and_listing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 0, "y"), ("b", 0, "z")], "doc string, chunk int, text string")
    files.write_by_document(rows, f"file://{tmp_path}/chunks", "doc", "chunk")
    found = [r["path"] for r in files.find_files(spark, f"file://{tmp_path}/chunks", ("*.json", "*.none")).collect()]
    assert len(found) == 2 and found == sorted(found)
    lines = [json.loads(x)["text"] for x in next((tmp_path / "chunks/doc=a").glob("*.json")).read_text().splitlines()]
    assert lines == ["y", "x"]
    assert files.find_files(spark, f"file://{tmp_path}/chunks", "*.json", after="2999-01-01").count() == 0
    records, summary = files.write_records(rows, rows.groupBy().count(), f"file://{tmp_path}", "fast")
    assert records.endswith("records_fast") and spark.read.json(summary).first()["count"] == 3


def test_overlap_of_words_against_sets(spark):
    """A word that all have, empty and null words, repeated rows and ties, in three tasks."""
    from tidemark.operators import search

    rng = np.random.default_rng(3)
    rows = [(i, ["the", *sorted({f"w{x}" for x in rng.integers(0, 9, 4)})]) for i in range(40)] + [(40, []), (41, None), (5, ["w1"])]
    df = spark.createDataFrame(rows, "id long, w array<string>").repartition(3)
    found = {}
    for r in search.top_overlap(df.where("id % 20 = 0 OR id = 41"), df, 6).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["row_id"], r["score"]))
    assert sorted(found) == [0, 20, 40, 41]
    for q, got in found.items():
        own = set(dict(rows)[q] or [])
        scored = sorted((-round(len(own & set(w or [])) / max(len(own), 1), 6), i) for i, w in rows if i != q)
        assert got == [(i, -s) for s, i in scored[:6]]
    assert search.top_overlap(df.limit(0), df, 3).count() == search.top_overlap(df, df.limit(0), 3).count() == 0
