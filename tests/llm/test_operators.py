"""The llm operators on small rows: brute force, round trips, held-out accuracy, and odd input."""

from __future__ import annotations

import dataclasses
import hashlib
import io
import random
import re
import tarfile
import zlib
from urllib.parse import urljoin

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import chat, fingerprints, lines, media, mixing, neardup, pieces, quality, shards, urls
from tidemark.llm.common import Workspace
from tidemark.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, hash string, rank int"


def docs(spark, rows):
    """Rows (doc_id, text) with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 0.5, "h", 1) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (5, "two words"), (None, "no id here at all"), (None, None), (6, "tie tie tie tie"), (7, "tie tie tie tie"), (8, "x" * 70000), (9, "long word list " * 6000), (10, "naïve — ‰ 😀 ▁ ퟿")]


def prose(rng, n, words=900):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# components


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(0, k) for k in range(300, 400)] + [(k, k + 1) for k in range(500, 540)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    found = connected_components(spark.createDataFrame([*links, (None, 1)], "a long, b long"), Workspace(spark, "t"))
    assert {r["id"]: r["component"] for r in found.collect()} == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


# 1 mixing


def test_mixing_reaches_targets(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60) + (" zebra zoo" if i % 3 == 0 else " apple ape")) for i in range(300)]
    labels = spark.createDataFrame([(i, "z" if i % 3 == 0 else "a") for i in range(0, 300, 2)], "doc_id long, domain string")
    m = mixing.Mix(targets={"a": 0.8, "z": 0.2})
    rates, found = mixing.mixed(docs(spark, rows), labels, Workspace(spark, "t"), m)
    assert found["reached"] == pytest.approx(found["goal"], rel=0.02)
    got = rates.collect()
    assert len(got) == 300 and all(0 <= r["rate"] <= m.max_rate and abs(r["copies"] - r["rate"]) < 1 for r in got)
    assert all((r["p_z"] > 0.5) == (r["doc_id"] % 3 == 0) for r in got)
    copied = mixing.resampled(docs(spark, rows), labels, Workspace(spark, "t"), m)
    assert copied.columns == docs(spark, rows).columns
    assert copied.count() == sum(r["copies"] for r in got)


def test_mixing_reaches_targets_of_rare_domains(spark):
    rng = np.random.default_rng(13)
    n = rng.integers(20, 200, 600)
    light = spark.createDataFrame([(int(a), float(i % 100 != 0), float(i % 100 == 0)) for i, a in enumerate(n)], "n_tokens long, p_0 double, p_1 double")
    _, found = mixing.fit(light, Workspace(spark, "t"), mixing.Mix(targets={"a": 0.95, "b": 0.05}))
    assert found["natural"][1] < 0.02 * sum(found["natural"]) and found["reached"] == pytest.approx(found["goal"], rel=0.01)


@pytest.mark.parametrize(("most", "ridge"), [(float("inf"), 1e-3), (1.5, 3e-2)])
def test_mixing_fit_is_the_minimum(spark, most, ridge):
    rng = np.random.default_rng(14)
    n, p = rng.integers(1, 50, 80), rng.dirichlet([0.3, 0.3, 0.1], 80)
    light = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n_tokens long, p_0 double, p_1 double, p_2 double")
    m = mixing.Mix(targets={"a": 0.6, "b": 0.1, "c": 0.3}, max_rate=most, ridge=ridge)
    rated, found = mixing.fit(light, Workspace(spark, "t"), m)
    a = n[:, None] * p
    goal = np.array([0.6, 0.1, 0.3]) * a.sum(0)[0] / 0.6
    gram = a.T @ a
    inv = np.linalg.inv(gram + 0.01 * np.trace(gram) * np.eye(3))
    step, r = 1 / (1 + m.ridge), np.ones(80)
    for _ in range(40000):
        r = np.clip(r * (1 - step * m.ridge) - step * a @ (inv @ (a.T @ r - goal)) + step * m.ridge, 0, most)
    assert found["reached"] == pytest.approx(list(a.T @ r), rel=1e-4)
    got = {(x["n_tokens"], x["p_0"]): x["rate"] for x in rated.collect()}
    mine = np.array([got[int(i), float(q[0])] for i, q in zip(n, p)])
    far = lambda r: (a.T @ r - goal) @ inv @ (a.T @ r - goal) + m.ridge * ((r - 1) ** 2).sum()
    assert far(mine) == pytest.approx(far(r), rel=1e-5) and mine.max() <= most and mine == pytest.approx(r, abs=0.01)


def test_mixing_fit_of_targets_out_of_reach_is_the_minimum(spark):
    """Each document is a tenth of each domain at least, so no rates give one of them a twentieth; Newton steps on the dual give the least squares."""
    rng = np.random.default_rng(16)
    n, p = rng.integers(1, 50, 120), rng.dirichlet([0.4, 0.4, 0.4], 120) * 0.7 + 0.1
    light = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n_tokens long, p_0 double, p_1 double, p_2 double")
    m = mixing.Mix(targets={"a": 0.94, "b": 0.03, "c": 0.03}, ridge=0.1)
    rated, found = mixing.fit(light, Workspace(spark, "t"), m)
    a = n[:, None] * p
    goal, gram = np.array([0.94, 0.03, 0.03]) * a.sum(0)[0] / 0.94, a.T @ a
    wide = gram + 0.01 * np.trace(gram) * np.eye(3)
    z = np.zeros(3)
    for _ in range(200):
        r = np.maximum(0, 1 - a @ z)
        free = r > 0
        z = z - 0.5 * np.linalg.solve(m.ridge * wide + a[free].T @ a[free], m.ridge * wide @ z + goal - a.T @ r)
    far = lambda r: (a.T @ r - goal) @ np.linalg.inv(wide) @ (a.T @ r - goal) + m.ridge * ((r - 1) ** 2).sum()
    got = {(x["n_tokens"], x["p_0"]): x["rate"] for x in rated.collect()}
    mine = np.array([got[int(i), float(q[0])] for i, q in zip(n, p)])
    assert far(mine) == pytest.approx(far(r), rel=1e-4) and found["reached"] == pytest.approx(list(a.T @ r), rel=1e-3)
    assert np.abs(a.T @ r - goal).max() > 0.02 * goal.sum()


def test_mixing_knows_documents_without_telling_words(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, 60) + (" zebra" if i % 10 == 0 else " apple" if i % 10 == 1 and i % 30 else "")) for i in range(900)]
    labels = spark.createDataFrame([(i, {0: "z", 1: "a"}.get(i % 10, "c")) for i in range(900)], "doc_id long, domain string")
    m = mixing.Mix(targets={"a": 0.05, "c": 0.9, "z": 0.05})
    rates, found = mixing.mixed(docs(spark, rows), labels, Workspace(spark, "t"), m)
    got = rates.collect()
    assert all(r["p_c"] > 0.9 for r in got if r["doc_id"] % 10 > 1) and all(r["p_z"] > 0.9 for r in got if r["doc_id"] % 10 == 0)
    assert found["reached"] == pytest.approx(found["goal"], rel=0.02)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_mixing_reaches_targets_on_documents(spark, sf, size):
    sf = sf.replace("sf0.001", size)
    labels = mixing.label_domains(spark.read.parquet(f"{sf}/labels.parquet"))
    table, work = spark.read.parquet(f"{sf}/documents.parquet"), Workspace(spark, "t")
    rates, found = mixing.mixed(table, labels, work)
    assert found["domains"] == ["clean", "low", "toxic"] and found["reached"] == pytest.approx(found["goal"], rel=0.001)
    light = work.write(rates.select("n_tokens", *(F.col(f"p_{d}").alias(f"p_{k}") for k, d in enumerate(found["domains"]))), "light")
    _, thirds = mixing.fit(light, work, mixing.Mix(targets={"clean": 0.34, "low": 0.33, "toxic": 0.33}))
    assert thirds["reached"] == pytest.approx(thirds["goal"], rel=0.001)


def plain_posteriors(rows, labels, m, temperature):
    """(sums of weights or of none) in plain Python: {doc_id: posterior}, with the same hash of words and shapes."""
    blank, signs = "[ \n\t\r]+", "[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]"

    def buckets(text):
        found = set()
        for w in filter(None, re.split(blank, text)):
            found.add(re.sub(f"^{signs}+|{signs}+$", "", w.lower()))
            found.add(re.sub("[0-9]+", "\x03", re.sub("[A-Z]+", "\x02", re.sub("[^\x00-\x40\x5b-\x60\x7b-\x7eA-Z]+", "\x01", w))))
        signed = lambda f: (h := xxhash.xxh64(f.encode(), seed=42).intdigest()) - (h >> 63 << 64)
        return {signed(f) % m.buckets for f in found - {""}}

    names = sorted(m.targets)
    of = {i: buckets(t) for i, t in rows}
    label = {i: min(d for j, d in labels if j == i) for i, _ in labels if i in of}
    size = [sum(d == n for d in label.values()) for n in names]
    weights = {}
    for b in set().union(*(of[i] for i in label)):
        n = [sum(b in of[i] for i, d in label.items() if d == name) for name in names]
        e = [s * sum(n) / sum(size) for s in size]
        ratio = 2 * sum(x * np.log(x / z) for x, z in [*zip(n, e), *((s - x, s - z) for s, x, z in zip(size, n, e))] if x > 0)
        r = np.log([(x + 1) / (s + 2) for x, s in zip(n, size)])
        if ratio >= m.telling and np.sort(r)[-1] - np.sort(r)[-2] >= m.contrast:
            weights[b] = r - r.mean()
    some = [sum(bool(of[i] & set(weights)) for i, d in label.items() if d == name) for name in names]
    prior = np.log([(s + 1) / (sum(size) + len(names)) for s in size])
    out = {}
    for i, found in of.items():
        told = [weights[b] for b in found if b in weights]
        logits = prior + (sum(told) / temperature if told else np.log([(s - x + 1) / (s + 2) for s, x in zip(size, some)]))
        out[i] = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
    return out


def test_posteriors_equal_brute_force_and_tell_held_out_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), mixing.label_domains(spark.read.parquet(f"{sf}/labels.parquet"))
    rows, m, work = [(r["doc_id"], r["text"]) for r in table.collect()], mixing.Mix(), Workspace(spark, "t")
    taught = labels.where(~quality.held_out())
    model = mixing.learn(table, taught, work, m)
    wanted = plain_posteriors(rows, [tuple(r) for r in taught.collect()], m, model.temperature)
    got = {r["doc_id"]: [r["p_0"], r["p_1"], r["p_2"]] for r in mixing.posteriors(table, model, m, ["doc_id"]).collect()}
    assert all(got[i] == pytest.approx(list(p), abs=1e-9) for i, p in wanted.items()) and len(got) == len(rows)
    names = sorted(m.targets)
    right = [names[int(np.argmax(got[r["doc_id"]]))] == r["domain"] for r in labels.where(quality.held_out()).collect()]
    assert np.mean(right) > 0.9 and model.temperature in m.temperatures


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_the_temperature_lowers_the_loss_on_held_out_labels(spark, sf, size):
    sf = sf.replace("sf0.001", size)
    table, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), mixing.label_domains(spark.read.parquet(f"{sf}/labels.parquet"))
    m, work = mixing.Mix(), Workspace(spark, "t")
    model = mixing.learn(table, labels.where(~quality.held_out()), work, m)
    held, names, loss = labels.where(quality.held_out()), sorted(m.targets), {}
    for t in (1.0, model.temperature):
        p = mixing.posteriors(table.join(held.select("doc_id"), "doc_id"), dataclasses.replace(model, temperature=t), m, ["doc_id"]).join(held, "doc_id").collect()
        loss[t] = -np.mean([np.log(max(r[f"p_{names.index(r['domain'])}"], 1e-12)) for r in p])
    print(size, model.temperature, loss)
    assert loss[model.temperature] <= loss[1.0] * 1.001 and loss[model.temperature] < 0.36


def test_labels_of_no_document_teach_nothing(spark):
    rng = random.Random(15)
    rows = [(i, prose(rng, 40) + (" zebra" if i % 4 == 0 else "")) for i in range(200)]
    own = [(i, "z" if i % 4 == 0 else "c") for i in range(200)]
    gone = [(i, "z") for i in range(1000, 3000)]
    m = mixing.Mix(targets={"c": 0.8, "z": 0.2}, per_class=150)
    found = []
    for labels in (own, own + gone):
        model = mixing.learn(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, domain string"), Workspace(spark, "t"), m)
        found.append((sorted(map(tuple, model.weights.collect())), model.priors, model.none, model.temperature))
    assert found[0] == found[1] and found[0][0]


def test_mixing_odd_input(spark):
    labels = spark.createDataFrame([(4, "clean"), (4, "low"), (None, "low"), (99, "toxic"), (5, None)], "doc_id long, domain string")
    rates, _ = mixing.mixed(docs(spark, ODD), labels, Workspace(spark, "t"))
    assert rates.count() == len(set(ODD))
    assert mixing.mixed(docs(spark, []), labels, Workspace(spark, "t"))[0].count() == 0
    assert mixing.resampled(docs(spark, ODD), labels.limit(0), Workspace(spark, "t")).columns == docs(spark, []).columns


# 2 near duplicates


def brute(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.setdefault(i, []).append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[i] for t in sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def family(rng, base, n, edits):
    words = base.split()
    for _ in range(n):
        out = list(words)
        for _ in range(edits):
            out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
        yield " ".join(out)


@pytest.mark.parametrize(("limit", "chunk", "block", "dense_from"), [(32, 256, 256, 3), (4, 6, 3, 1)])
def test_near_duplicates_equal_brute_force(spark, limit, chunk, block, dense_from):
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(3, 120)) for _ in range(60)]
    for edits in (2, 6, 10):
        texts += family(rng, prose(rng, 110), 25, edits)
    texts += [texts[0], texts[0].upper(), "a b", "a b", "one", "one", "", "  "]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    p = neardup.ChosenPath(width=2, limit=limit, chunk=chunk, block=block, dense_from=dense_from)
    found = neardup.near_duplicates(docs(spark, rows), Workspace(spark, "t"), p).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute(rows, 2)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


@pytest.mark.parametrize("percent", [50, 90])
def test_near_duplicates_at_other_limits_equal_brute_force(spark, percent):
    rng = random.Random(percent)
    texts = [prose(rng, rng.randrange(3, 90)) for _ in range(30)]
    for edits in (1, 4, 8, 14, 20):
        texts += family(rng, prose(rng, 110), 12, edits)
    rows = list(enumerate(texts))
    p = neardup.ChosenPath(width=2, percent=percent)
    found = neardup.near_duplicates(docs(spark, rows), Workspace(spark, "t"), p).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute(rows, 2, percent)


def test_trees_follow_from_percent_and_recall():
    p = neardup.ChosenPath()
    assert (p.trees, p.branch) == (4, 2) and neardup.missed(p, 4) <= 1e-4 < neardup.missed(p, 3)
    low, sure = neardup.ChosenPath(percent=50), neardup.ChosenPath(recall=0.999999)
    assert low.branch == 3 and neardup.missed(low, low.trees) <= 1e-4 and sure.trees > p.trees
    assert (neardup.ChosenPath(trees=7, branch=5).trees, neardup.ChosenPath(trees=7, branch=5).branch) == (7, 5)


def test_near_duplicates_odd_input(spark):
    found = neardup.near_duplicates(docs(spark, ODD), Workspace(spark, "t")).collect()
    assert len(found) == len(ODD)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["n_shingles"] for i in (1, 2, 3) for r in by[i]] == [0, 0, 0]
    assert [r["component_id"] for i in (1, 2, 3, 4, 5) for r in by[i]] == [1, 2, 3, 4, 4, 5]
    assert by[7][0]["component_id"] == 6 and not by[7][0]["kept"] and all(r["kept"] for r in by[None])
    assert neardup.near_duplicates(docs(spark, []), Workspace(spark, "t")).count() == 0
    left = neardup.deduplicated(docs(spark, ODD), Workspace(spark, "t"))
    assert left.columns == docs(spark, []).columns and left.count() == len(ODD) - 1


def test_near_duplicates_equal_brute_force_on_documents(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in table.collect()]
    for width in (2, 5):
        found = neardup.near_duplicates(table, Workspace(spark, "t"), neardup.ChosenPath(width=width)).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == brute(rows, width)


# 3 fingerprints


def test_fingerprints_are_homomorphic(spark):
    wide, count = fingerprints.wide, fingerprints.counts
    df = spark.createDataFrame([("a b c\nd e f g\nh", "h\na b c\nd e f g", "a b c\nh", "d e f g")], "x string, moved string, less string, part string")
    r = df.select(*(wide(F.col(c)).alias(c) for c in df.columns), *(count(F.col(c)).alias(f"n_{c}") for c in df.columns), fingerprints.delete(wide(F.col("x")), wide(F.col("part"))).alias("deleted"), fingerprints.insert(wide(F.col("less")), wide(F.col("part"))).alias("inserted")).first()
    assert r["x"] == r["moved"] == r["inserted"] and r["deleted"] == r["less"] != r["x"]
    assert r["n_x"] == r["n_moved"] and r["n_x"]["s0"] == r["n_less"]["s0"] + r["n_part"]["s0"]


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [*{(i, t) for i, t in ODD if i is not None}, *((100 + k, prose(rng, 80) + "\n" + prose(rng, 40)) for k in range(6))]
    found = {r["doc_id"]: r for r in fingerprints.compare(docs(spark, [*rows, rows[0]]), Workspace(spark, "t")).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)]
        m = len(t) // 3
        edited = t[: len(t) - m] + (after[1] or "")[:m]
        assert (found[i]["n_chars"], found[i]["edited_sha256"], found[i]["next_id"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), after[0])
        assert (found[i]["fingerprint"] == found[i]["edited_fingerprint"]) == (edited == t)
        assert 0 <= found[i]["near_edited"] <= 1 and 0 <= found[i]["near_next"] <= 1
        if i >= 100:
            assert abs(found[i]["near_edited"] - 2 / 3) < 0.3 and found[i]["near_next"] < 0.4
    assert found[6]["fingerprint"] == found[7]["fingerprint"] and found[7]["near_next"] == 1
    assert fingerprints.compare(docs(spark, []), Workspace(spark, "t")).count() == 0
    assert fingerprints.compare(docs(spark, ODD), Workspace(spark, "t")).count() == len(ODD)


# 4 chat


def test_chat_round_trip_and_machine(spark):
    rows = [
        (1, 0, "system", "be [INST] brief"), (1, 1, "user", "a\\</s>\\"), (1, 2, "assistant", "<|end|><|turn|>user<|text|>"), (2, 0, "user", None), (2, 1, "user", "again"),
        (3, 0, "wizard", "x"), (None, 0, None, "y"), (4, None, "user", "n"), (4, 1, "assistant", "<\\/s>"), (4, 1, "assistant", "<\\/s>"),
    ]
    t = chat.Template()
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("state", F.lit("clash")))
    found = {r["conv_id"]: r for r in made.select("*", chat.read_turns(F.col("formatted"), t).alias("turns"), chat.loss_text(F.col("segments"), t).alias("loss")).collect()}
    assert [(x["role"], x["text"]) for x in found[1]["turns"]] == [(r, x) for c, _, r, x in rows if c == 1]
    assert found[1]["valid"] and found[1]["loss"] == "<|end|><|turn|>user<|text|>" and found[1]["formatted"].count("<|end|>") == 3
    assert "".join(s["text"] for s in found[1]["segments"]) == found[1]["formatted"]
    assert (found[2]["valid"], found[2]["first_bad_turn"], found[2]["loss"]) == (False, 1, "")
    assert (found[3]["first_bad_turn"], found[3]["state"]) == (0, "invalid")
    assert [(x["role"], x["text"]) for x in found[None]["turns"]] == [("", "y")]
    assert found[4]["n_turns"] == 3 and found[4]["loss"] == "<\\/s>" * 2 and not found[4]["valid"]
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 5 quality


def test_gradients_equal_differences():
    rng = np.random.default_rng(6)
    model = quality.AttentionMil(hidden=3, gate=2)
    x, bag, y, weight = rng.normal(size=(7, 4)), np.array([0, 0, 1, 1, 1, 2, 2]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    p = {k: rng.normal(size=s) for k, s in {"W": (4, 3), "b": (3,), "V": (3, 2), "U": (3, 2), "w": (2,), "c": (3,), "d": ()}.items()}

    def loss(q):
        s = model._forward(q, x, bag, 3)["score"]
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / 3

    g = model._gradients(p, x, bag, y, weight)
    for k in p:
        for at in np.ndindex(p[k].shape):
            a, b = ({**p, k: p[k] + d * np.eye(1, p[k].size, np.ravel_multi_index(at, p[k].shape) if at else 0).reshape(p[k].shape)} for d in (1e-5, -1e-5))
            assert (loss(a) - loss(b)) / 2e-5 == pytest.approx(g[k][at], abs=1e-6)


def test_quality_held_out_accuracy(spark):
    from tests.conftest import SF

    sf = SF.replace("sf0.001", "sf0.01")
    found = quality.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    right = {r["held_out"]: r["a"] for r in found.groupBy("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a")).collect()}
    assert right[True] > 0.95


def test_quality_odd_input(spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 1), (6, 0), (9, None), (8, 7), (None, 1), (77, 0)], "doc_id long, quality int")
    model = quality.train(docs(spark, ODD), labels, "quality")
    found = quality.score(docs(spark, ODD), model)
    assert found.columns[-1] == "score" and len(found.columns) == len(docs(spark, []).columns)
    rows = found.collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert quality.score(docs(spark, []), model).count() == 0
    assert quality.train(docs(spark, []), labels, "quality").value == 0.5
    assert quality.train(docs(spark, ODD), labels.where("doc_id = 5"), "quality").value == 1.0


def test_quality_learns_from_whole_texts_of_a_bounded_sample(spark):
    good, bad = "Plain words make a good line of prose.", "@@## $$%% ^^&& 1234 !!??"
    rows = [(i, "\n".join([bad if i % 2 else good] * (3 + i % 5))) for i in range(60)] + [(60, "\n".join([good] * 900)), (1, good), (1, bad)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(61)], "doc_id long, quality int")
    seen = []

    class Spy(quality.AttentionMil):
        def fit(self, x, owner, y):
            seen.append(np.bincount(owner, minlength=len(y)).tolist())
            return super().fit(x, owner, y)

    for passages in (200_000, 200_000, 5000, 150):
        quality.train(docs(spark, rows), labels, "quality", passages=passages, model=Spy(epochs=1))
    sizes = sorted([1 if i == 1 else 3 + i % 5 for i in range(60)])
    assert seen[0] == seen[1] and sorted(seen[0]) == [*sizes, 900] and sorted(seen[2]) == sizes
    assert 0 < sum(seen[3]) <= 150 and max(seen[3]) <= 3


def test_quality_scores_equal_a_plain_forward_pass(spark):
    rng = np.random.default_rng(9)
    p = {k: rng.normal(size=s) for k, s in {"W": (quality.FEATURES, 3), "b": (3,), "V": (3, 2), "U": (3, 2), "w": (2,), "c": (3,), "d": ()}.items()}
    model = quality.AttentionMil(hidden=3, gate=2)
    model.p, model.mean, model.std = p, rng.normal(size=quality.FEATURES), np.ones(quality.FEATURES)
    rows = [(i, t) for i, t in ODD if i is not None]
    for r in quality.score(docs(spark, rows), model).collect():
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        x = np.clip((quality.encode(raw, np.array([0, len(raw)]))[0] - model.mean) / model.std, -6, 6)
        h = [np.tanh(v @ p["W"] + p["b"]) for v in x]
        e = np.array([p["w"] @ (np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) for v in h])
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        z = sum(k * v for k, v in zip(a, h))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30))), abs=1e-6)


def test_passages_cover_texts():
    texts = ["", "ab", "x" * 1500, "a\nb\n", "\n", "é" * 700]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    cut, owner = quality.passage_bounds(np.frombuffer(b"".join(raw), np.uint8), bounds)
    assert list(np.bincount(owner)) == [1, 1, 3, 2, 1, 3] and all(bounds[o] <= c <= bounds[o + 1] for c, o in zip(cut, owner))


# 6 media


def test_media_round_trip(spark):
    index, folder = media.store(docs(spark, ODD), Workspace(spark, "t"), shard_bytes=40000)
    placed = media.fill_metadata(index, folder)
    found = media.attach(docs(spark, ODD).withColumn("digest", F.lit("clash")).withColumn("offset", F.lit(1)), media.read_features(placed, folder))
    rows = found.withColumn("payload", F.lower(F.hex("payload_sha256"))).collect()
    assert len(rows) == len(ODD)
    wanted = {}
    for i, t in ODD:
        p = media.padded((t or "").encode())
        wanted.setdefault(i, set()).add((len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p) // 64))
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], set()).add((r["n_bytes"], r["payload_bytes"], r["payload"], r["tail_crc32"], r["height"]))
        assert r["media_sha256"] == r["read_sha256"] and (r["width"], r["bits"]) == (64, 8)
    assert got == wanted
    fs, base = media.open_folder(folder)
    seen = set()
    for name in {r["shard"] for r in rows}:
        with tarfile.open(fileobj=io.BytesIO(fs.open_input_file(f"{base}/{name}").read())) as tar:
            seen |= {m.name: media.from_png(tar.extractfile(m).read()) for m in tar}.items()
    assert all(hashlib.sha256(p).hexdigest() + ".png" == n for n, p in seen) and len(seen) == len({t or "" for _, t in ODD})
    assert media.store(docs(spark, []), Workspace(spark, "t"))[0].count() == 0


def test_media_copies_of_several_tasks_are_stored_once(spark):
    rng = random.Random(17)
    rows = [(i, prose(rng, 300) if i % 4 == 0 else "the same words " * 400 + str(i % 3)) for i in range(64)]
    table = docs(spark, rows).repartition(16, "doc_id")
    index, folder = media.store(table, Workspace(spark, "t"), waste=0.0)
    fs, base = media.open_folder(folder)
    members = []
    for f in fs.get_file_info(media.pafs.FileSelector(base)):
        if f.base_name.endswith(".tar"):
            with tarfile.open(fileobj=io.BytesIO(fs.open_input_file(f.path).read())) as tar:
                members += [m.name for m in tar]
    assert len(members) == len(set(members)) == index.count() == 16 + 3
    found = media.read_features(index, folder).collect()
    assert {bytes(r["payload_sha256"]) for r in found} == {hashlib.sha256(media.padded(t.encode())).digest() for _, t in rows}
    loose, _ = media.store(table, Workspace(spark, "t"), waste=1.0)
    assert loose.count() == index.count()


def test_a_shard_of_another_attempt_stays(tmp_path):
    one = media.ShardWriter(f"file://{tmp_path}", 3, 1 << 20)
    one.add("a.png", b"x" * 100)
    two = media.ShardWriter(f"file://{tmp_path}", 3, 1 << 20)
    two.add("a.png", b"x" * 100)
    one.close()
    two.fs = type("Refusing", (), {"get_file_info": two.fs.get_file_info, "delete_file": two.fs.delete_file, "move": None})()
    two.close()
    assert [f.name for f in tmp_path.iterdir()] == ["shard-00003-00000.tar"]


# 7 lines


def cut_runs(rows, least=2):
    """Brute force: every run of lines, from one that is not blank to another, that an earlier place has."""
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0])):
        parts = t.split("\n")
        full, gone = [k for k, x in enumerate(parts) if x.strip(" \t\r")], set()
        for a, k in enumerate(full):
            runs = [(k, e) for e in full[a + least - 1 :]]
            gone |= {x for k, e in runs if tuple(parts[k : e + 1]) in seen for x in range(k, e + 1)}
            seen |= {tuple(parts[k : e + 1]) for k, e in runs}
        ends = ["\n"] * (len(parts) - 1) + [""]
        out[i, t] = "".join(x + e for k, (x, e) in enumerate(zip(parts, ends)) if k not in gone), len(gone)
    return out


def cut_pairs(rows):
    """{id: (text, lines removed)} by pairs of adjacent lines that are not blank, seen at an earlier place."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        parts, gone = t.split("\n"), set()
        full = [k for k, x in enumerate(parts) if x.strip(" \t\r")]
        for a, b in zip(full, full[1:]):
            pair = tuple(parts[a : b + 1])
            gone |= set(range(a, b + 1)) if pair in seen else set()
            seen.add(pair)
        ends = ["\n"] * (len(parts) - 1) + [""]
        out[i] = "".join(x + e for k, (x, e) in enumerate(zip(parts, ends)) if k not in gone), len(gone)
    return out


def test_lines_equal_brute_force_over_all_runs(spark):
    rng = random.Random(11)
    passage = [prose(rng, 6) for _ in range(9)]
    passage[4] = " "
    rows = []
    for i in range(60):
        own = [prose(rng, 5) for _ in range(rng.randrange(4))]
        k, a = rng.randrange(len(own) + 1), rng.randrange(8)
        rows.append((i, "\n".join([*own[:k], *passage[a : a + rng.randrange(1, 6)], *own[k:]]) + "\n" * rng.randrange(3)))
    rows += [(70, "é\nü\né\nü\né\nü\né\nü"), (71, None), (72, ""), (73, "\n\n\n"), (74, "a\na\na\na\n"), (None, rows[0][1])]
    found = lines.deduplicated_lines(docs(spark, [*rows, rows[3]]), Workspace(spark, "t"))
    assert found.columns == [*docs(spark, []).columns, "lines_removed", "bytes_removed"]
    wanted, by, got = cut_runs(rows), dict(rows), found.collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if by[r["doc_id"]] is None:
            assert r["text"] is None and r["bytes_removed"] == 0
        else:
            assert (r["text"], r["lines_removed"]) == wanted[r["doc_id"], by[r["doc_id"]]]
            assert r["bytes_removed"] == len(by[r["doc_id"]].encode()) - len(r["text"].encode())


def test_lines_recall_on_documents(spark, sf):
    """Every line of a repeated run goes, by a separate count, and no line that stands alone anywhere."""
    table = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in table.collect()]
    wanted = cut_pairs(rows)
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in lines.deduplicated_lines(table, Workspace(spark, "t")).collect()}
    assert got == wanted and sum(n for _, n in got.values()) > 1000


def test_lines_odd_input(spark):
    assert lines.deduplicated_lines(docs(spark, ODD), Workspace(spark, "t")).count() == len(ODD)
    assert lines.deduplicated_lines(docs(spark, []), Workspace(spark, "t")).count() == 0


def test_the_line_stage_removes_every_repeated_run(spark, sf):
    import corpus_pipeline

    rows = [(1, "x\np\nq\ny"), (2, "k\np\nq\nl"), (3, "p\nq"), (4, "m\np\nq")]
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, docs(spark, rows), sf).collect()}
    assert left == {1: "x\np\nq\ny", 2: "k\nl", 3: "", 4: "m\n"}


# 8 urls


def test_urls_rules_and_aliases(spark):
    link = '<html><head><link href="{}" rel=canonical></head>'
    pages = [
        (1, "https://A.Example.com/en/7x?q", None), (2, "http://example.com/en/8", ""), (3, "http://notexample.com/en/7", ""), (4, "http://x.net/de/8", ""), (5, "http://www.example.net/de/8#a", ""),
        (6, None, None), (7, "no scheme", ""), (8, "http://free.test/a#top", link.format("http://b.org/es/")), (9, "http://free.test/c", '<meta http-equiv="refresh" content="0; url=/a">'),
        (10, "http://other.test/", link.format("http://free.test/d")), (11, "http://free.test/a", ""), (11, "http://free.test/a", ""), (12, "http://both.test/", link.format("http://b.org/es/x")), (13, "http://c.com", ""),
    ]
    redirects = spark.createDataFrame([("http://both.test/", "http://example.com/en/7"), (None, "http://x.net"), ("http://free.test/c", "http://free.test/c")], "src string, dst string")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("verdict", F.lit("clash")).withColumn("node", F.lit(1))
    found = urls.judge(df, Workspace(spark, "t"), redirects=redirects)
    assert found.columns == ["page_id", "url", "html", "node", "host", "path", "rule", "verdict", "decided_by"]
    got = [(r["page_id"], r["host"], r["rule"], r["verdict"], r["decided_by"]) for r in found.orderBy("page_id").collect()]
    assert got == [
        (1, "a.example.com", "example.com/en/7", "allow", "rule"), (2, "example.com", "com/en/", "block", "rule"), (3, "notexample.com", "com/en/", "block", "rule"), (4, "x.net", "net/de/", "allow", "rule"),
        (5, "www.example.net", "example.net/de/8", "block", "rule"), (6, "", None, "allow", "default"), (7, "", None, "allow", "default"), (8, "free.test", None, "block", "alias"), (9, "free.test", None, "block", "alias"),
        (10, "other.test", None, "allow", "default"), (11, "free.test", None, "block", "alias"), (11, "free.test", None, "block", "alias"), (12, "both.test", None, "allow", "alias"), (13, "c.com", None, "allow", "default"),
    ]
    assert urls.judge(df.limit(0), Workspace(spark, "t")).count() == 0
    with pytest.raises(ValueError):
        urls.rule_for(F.lit(""), F.lit(""), [("h", "/", "allow")] * (urls.MAX_RULES + 1))


def plain_node(url):
    """RFC 3986 normal form in plain Python; None without a host."""
    m = re.match(r"([^:/?#]+)://([^/?#]+)([^?#]*)(\?[^#]*)?", url, re.S)
    if not m:
        return None
    done = []
    for k, part in enumerate(parts := m[3].split("/")):
        if part == ".." and len(done) > 1:
            done.pop()
        if part in (".", "..") and k == len(parts) - 1:
            done.append("")
        elif part not in (".", ".."):
            done.append(part)
    return f"{m[1].lower()}://{m[2].lower()}{'/'.join(done) or '/'}{m[4] or ''}"


def linked_pages(rng, n):
    """(pages, links): pages with all kinds of links, and the links that a reader of them would follow."""
    hosts = [f"h{k}.{end}" for k in range(14) for end in ("com", "org", "net", "test")]
    path = lambda: rng.choice(["", "/", "/en/1", "/en/7", "/es/x", "/de/8/y", "/a/b/c.html", "/a/"])
    pages, links = [], []
    for i in range(n):
        url = f"{rng.choice(['http', 'https', 'HTTP'])}://{rng.choice(hosts).upper() if rng.random() < 0.2 else rng.choice(hosts)}{path()}{rng.choice(['', '', '?q=1', '#top'])}"
        parts, base = [], url
        if rng.random() < 0.15:
            parts.append(f'<base target=x href="{(to := rng.choice(["/sub/", "http://h1.com/es/", "mailto:x"]))}">')
            base = urljoin(url, to) if ":" not in to or "//" in to else url
        for _ in range(rng.randrange(3)):
            to = rng.choice([f"http://{rng.choice(hosts)}{path()}", f"//{rng.choice(hosts)}{path()}", "index.html", "../up", "../../../x/./y/..", "?p=2&q=3", "/en/7?a=1&b=<2>", "#frag", "", "mailto:a@b.test", "javascript:void(0)", "é/ü", " padded "])
            coded = to.replace("&", rng.choice(["&amp;", "&#38;", "&#x26;"])).replace("<", "&lt;").replace(">", "&gt;").replace("é", "&#233;")
            tag = rng.choice(
                [f'<link rel="canonical" href="{coded}">', f"<LINK title='a > b href=\"/no\"' HREF='{coded}' data-href=x rel='nofollow Canonical' />", f'<meta http-equiv="Refresh" content="0; URL={coded}">', f'<meta content="5;url=\'{coded}\'" http-equiv=refresh>']
            )
            if rng.random() < 0.2:
                parts.append(rng.choice([f"<!-- {tag} -->", tag.replace("anonical", "anonicals").replace("efresh", "efreshes"), f"<a {tag[5:]}"]))
                continue
            parts.append(tag)
            if to or tag[1:5].lower() == "link":
                links.append((url, urljoin(base, to.strip())))
        pages.append((i, url, "<html><head>" + "\n<p class=x>".join(parts)))
    return pages, links


def test_urls_with_all_kinds_of_links_equal_union_find_and_sql(spark):
    pages, links = linked_pages(random.Random(1), 150)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = plain_node(a), plain_node(b)
        if a and b:
            root[find(a)] = find(b)
    of_node = lambda n: own(n.split("://")[1].split("/")[0], re.match(r"[^/]*([^?]*)", n.split("://")[1], re.S)[1])

    def own(host, path):
        fits = [(-len(h + p), v != "allow", v, h + p) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return min(fits)[2:] if fits else None

    groups = {}
    for x in list(root):
        if found := of_node(x):
            groups.setdefault(find(x), set()).add(found[0])
    wanted = {}
    for i, url, _ in pages:
        host, path = re.match(r"[^:]*://([^/?#]*)([^?#]*)", url).groups()
        mine, node = own(host.lower(), path), plain_node(url)
        shared = min(groups[find(node)]) if node in root and find(node) in groups else None
        wanted[i] = (mine[0], mine[1], "rule") if mine else (shared, None, "alias") if shared else ("allow", None, "default")
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = urls.judge(df, Workspace(spark, "t")).select("page_id", "host", "path", "rule", "verdict", "decided_by").collect()
    assert {r["page_id"]: (r["verdict"], r["rule"], r["decided_by"]) for r in found} == wanted
    assert {"rule", "alias", "default"} == {r["decided_by"] for r in found}
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [p[0] for p in pages], "url": [p[1] for p in pages], "html": [p[2] for p in pages]}))
    assert sorted(map(tuple, found)) == sorted(con.execute(f"SELECT page_id, host, path, rule, verdict, decided_by FROM ({urls.OP8_SQL})").fetchall())


def test_a_relative_link_joins_no_other_site(spark):
    link = '<link rel=canonical href="{}">'
    pages = [(1, "http://a.org/es/x", link.format("index.html")), (2, "http://b.test/y", link.format("index.html")), (3, "http://c.test/z", link.format("//a.org/es/x")), (4, "http://d.test/", "<!-- " + link.format("http://a.org/es/x") + " -->"), (5, "http://e.test/?a=1&b", link.format("http://a.org/es/x?a&amp;b")), (6, "http://f.test", link.format("http://a.org/es/x?a&b"))]
    found = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), Workspace(spark, "t"))
    assert {r["page_id"]: r["verdict"] for r in found.collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "block", 6: "block"}


# 9 pieces


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel()


def test_pieces_without_dropout_equal_the_library(model, spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["a  b\n c ", " x", "", "  ", "日本語 テキスト", "😀\t\tx", "the" * 300, "x" * 500 + " and", "a   \nb"]
    found = pieces.Encoder(model, pieces.Dropout(0.0)).encode(texts, np.arange(len(texts)).astype(np.uint64))
    assert [x.tolist() for x in found] == [sp.encode(t) for t in texts]


def test_dropout_varies_repeats_and_decodes(model):
    text = "the international thing of interesting understanding " * 20
    keys = np.arange(4).astype(np.uint64)
    e = pieces.Encoder(model, pieces.Dropout(0.3))
    a, b = (e.encode([text] * 4, keys) for _ in range(2))
    assert all((x == y).all() for x, y in zip(a, b)) and len({x.tobytes() for x in a}) == 4
    assert all(model.decode(x.tolist()) == text.encode() for x in a)
    more = pieces.Encoder(model, pieces.Dropout(1.0)).encode(["hello"], keys[:1])[0]
    assert len(more) == 6


def test_each_occurrence_has_its_own_dropout(model):
    e = pieces.Encoder(model, pieces.Dropout(0.1))
    own = model.merge_units([" international"], np.zeros(1, np.int64), np.zeros(1, np.uint64), 0.0)[0].tobytes()
    ids = e.encode(["international " * 3000], np.arange(1).astype(np.uint64))[0].tolist()
    forms, at = [], []
    for k in ids:
        if model.text[k].startswith(b" ") and at:
            forms.append(np.array(at, np.int32).tobytes())
            at = []
        at.append(k)
    assert len(forms) >= 3000 and len(set(forms)) > 30 and own in forms
    words = e.encode(["in in in in in in in in"] * 500, np.arange(500).astype(np.uint64))
    assert 0 < np.mean([len(x) > 8 for x in words]) < 1 and len({x.tobytes() for x in words}) > 30


def test_steps_equal_the_agenda(model):
    rng = random.Random(8)
    units = [" " + "".join(rng.choice("thesaringtoncl") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    keys = np.arange(300).astype(np.uint64) * np.uint64(77)
    for share in (0.0, 0.25):
        flat, sizes = model.merge_units(units, np.arange(300), keys, share)
        for k, ids in enumerate(np.split(flat, np.cumsum(sizes)[:-1])):
            assert ids.tolist() == model._with_heap(units[k], keys[k], share).tolist()


def test_pieces_odd_input(spark, model):
    found = pieces.encoded(docs(spark, ODD).withColumn("pieces", F.lit("clash")), model)
    assert found.columns == [*(c for c in docs(spark, []).columns if c != "text"), "pieces", "lossless"]
    rows = found.collect()
    assert len(rows) == len(ODD) and all(r["lossless"] for r in rows)
    assert {r["doc_id"]: r["pieces"] for r in rows}[1] is None and {r["doc_id"]: r["pieces"] for r in rows}[2] == []
    assert pieces.encoded(docs(spark, []), model).count() == 0


# 10 shards


def test_shards_append_compact_and_commit(spark):
    store = shards.ShardStore(spark, Workspace(spark, "t").path, target_bytes=60000, least_bytes=2000)
    rows = docs(spark, ODD)
    assert store.version() == 0 and store.live() == []
    assert store.append(rows.repartition(5), "rank") == 1
    assert store.append(rows.repartition(3)) == 2
    before = [s.path for s in store.live()]
    assert store.compact() == 3 and len(store.live()) < len(before)
    for version in (2, 3):
        assert sorted(map(repr, store.read(version).collect())) == sorted(map(repr, rows.unionByName(rows).collect()))
    assert store.read().columns == rows.columns
    with pytest.raises(shards.CommitConflict):
        store.commit(2, [], set(), rows.schema)
    with pytest.raises(ValueError):
        store.append(rows.select("doc_id"))
    assert store.vacuum() >= len(before) and store.read().count() == 2 * len(ODD) and store.compact() == 3


def test_compacted_files_have_the_target_size(spark, sf):
    table = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/documents.parquet")
    store = shards.ShardStore(spark, Workspace(spark, "t").path, target_bytes=1 << 20, least_bytes=1 << 20)
    store.append(table.repartition(60))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    store.compact()
    sizes = sorted(s.bytes for s in store.live())
    assert len(sizes) > 4 and all(0.75 * (1 << 20) <= n <= 1.25 * (1 << 20) for n in sizes[1:]), sizes
    assert store.read().count() == table.count() and spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_manifests_hold_changes_and_every_so_often_all(spark, monkeypatch):
    monkeypatch.setattr(shards, "FULL_EVERY", 4)
    store = shards.ShardStore(spark, Workspace(spark, "t").path, fanout=3)
    counts = {}
    for k in range(6):
        counts[store.append(docs(spark, [(k, "x")]).coalesce(1))] = k + 1
    assert [len(store._manifest(v)) - 1 for v in range(1, 7)] == [1, 1, 1, 4, 1, 1]
    assert store.compact() == 7 and len(store.live()) == 1 and len(store.live(6)) == 6
    assert {v: store.read(v).count() for v in counts} == counts
    assert store.vacuum(keep=2) == 0 and store.read(6).count() == 6 and store.vacuum() == 6 and store.read().count() == 6


def test_vacuum_leaves_what_a_writer_has_not_committed_yet(spark):
    store, other = (shards.ShardStore(spark, Workspace(spark, "t").path) for _ in range(2))
    other.folder = store.folder
    rows = docs(spark, ODD)
    store.append(rows)
    new = store._written(rows, 2)
    assert other.vacuum() == 0
    assert store.commit(1, new, set(), rows.schema) == 2 and store.read().count() == 2 * len(ODD)
    assert other.vacuum() == 0 and not list(other.fs.listStatus(other._path(f"{store.folder}/leases")))
    # a writer that is gone: its lease runs out, and it cannot commit afterwards
    late = store._written(rows, 3)
    assert other.vacuum(lease=-5) == len(late)
    with pytest.raises(shards.CommitConflict):
        store.commit(2, late, set(), rows.schema)
    assert store.read().count() == 2 * len(ODD)
    # one that lost to another leaves files that go
    lost = store._written(rows, 3)
    other.append(rows)
    with pytest.raises(shards.CommitConflict):
        store.commit(2, lost, set(), rows.schema)
    assert other.vacuum() == len(lost) and store.read().count() == 3 * len(ODD)


def test_an_older_version_has_its_own_schema(spark):
    store = shards.ShardStore(spark, Workspace(spark, "t").path)
    store.append(docs(spark, ODD))
    wider = docs(spark, ODD).withColumn("more", F.lit(1))
    store.commit(1, store._written(wider, 2), {s.path for s in store.live()}, wider.schema)
    assert store.read(1).columns == docs(spark, []).columns and store.read().columns == wider.columns


def test_shards_of_an_empty_table(spark):
    store = shards.ShardStore(spark, Workspace(spark, "t").path)
    store.append(docs(spark, []))
    assert store.compact() >= 1 and store.read().count() == 0


def test_components_make_no_round_that_moves_nothing(spark):
    def rounds(links):
        work = Workspace(spark, "t")
        found = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), work).collect()}
        return found, work._count

    stars = [(1, k) for k in range(2, 9)] + [(20, 30)]
    assert rounds(stars) == ({k: 1 for k in range(1, 9)} | {20: 20, 30: 20}, 1)
    found, tables = rounds([(k, k + 1) for k in range(1, 4)])
    assert found == {k: 1 for k in range(1, 5)} and tables <= 1 + 4 * 2
