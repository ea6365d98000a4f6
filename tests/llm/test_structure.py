"""Repair, manifest and decontamination on small rows: brute force and odd input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import common, contamination, merkle, repair
from tidemark.llm.common import Workspace


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_numbers_of_rows_with_null_keys_and_ties(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1, 2, 3])) for _ in range(500)]
    got = common.numbered(spark.createDataFrame(rows, "k string, v int"), Workspace(spark, "t"), ["k"], ["v"], "nth").collect()
    for k in (None, "a", "b"):
        mine = sorted((r["nth"], r["v"] or 0) for r in got if r["k"] == k)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and [v for _, v in mine] == sorted(v for _, v in mine)


# 11 repair


def least(turns):
    """(cost, audit, lines) by trying all edits of a few turns (role, text, fault)."""
    best = None

    def go(i, roles, cost, audit, lines):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
        if not any(re.fullmatch("(s?(ua)+)?", roles + more) for more in ("", "a", "ua")):
            return
        if len(audit) < 2 * len(turns) + 2:
            for role in ("user", "assistant"):
                go(i, roles + role[0], cost + 3, audit + "I", [*lines, f"{role}:"])
        if i < len(turns):
            role, text, fault = turns[i]
            go(i + 1, roles, cost + 4, audit + "D", lines)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                go(i + 1, roles + role[:1], cost + more, audit + "K", [*lines, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    go(i + 1, roles + new[0], cost + more + 3, audit + "R", [*lines, f"{new}:{text}"])

    go(0, "", 0, "", [])
    return best


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "none" if bare[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    return out


def coded(turns):
    return "".join((r[:1] if r[:1] in ("s", "u", "a") else "-" if r else "_") + {"blank": "x", "duplicate": "x", "truncated": "t", "none": "k"}[f] for r, _, f in turns)


TURN = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "unknown", ""]), st.sampled_from(["", " \n", "Yes.", "No", "Why?", "b"]))


@settings(deadline=None, max_examples=150)
@given(st.lists(TURN, max_size=5))
def test_search_gives_the_least_of_all_edits(turns):
    turns = faults(turns)
    cost, audit, _ = least(turns)
    assert list(repair.search(coded(turns), 0, True, repair.Costs()).values()) == [(cost, audit)]


@settings(deadline=None, max_examples=100)
@given(st.lists(TURN, min_size=3, max_size=30), st.data())
def test_blocks_joined_give_what_one_search_gives(turns, data):
    codes = coded(faults(turns))
    cuts = sorted(data.draw(st.sets(st.integers(1, len(turns) - 1), min_size=1, max_size=4)))
    parts = [codes[2 * a : 2 * b] for a, b in zip([0, *cuts], [*cuts, len(turns)])]
    paths = [[dict(entry=e, exit=q, cost=c, audit=a) for e in (range(4) if k else (0,)) for q, (c, a) in repair.search(p, e, k == len(parts) - 1, repair.Costs()).items()] for k, p in enumerate(parts)]
    whole = paths[0]
    for p in paths[1:]:
        whole = repair.joined(whole, p)
    assert min((p["cost"], p["audit"]) for p in whole) == min(repair.search(codes, 0, True, repair.Costs()).values())


CONVS = "conv long, turn long, role string, text string"


def repaired(spark, rows):
    df, work = spark.createDataFrame(rows, CONVS), Workspace(spark, "t")
    found = repair.repairs(df, work)
    turns = repair.repaired(df, found)
    return {r["conv"]: r for r in found.collect()}, turns.collect(), {r["conv"]: r["sha256"] for r in repair.hashed(turns).collect()}


def test_repair_of_odd_conversations(spark):
    rng = random.Random(2)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No", "", None, "Why?", " ", "x" * 5000 + "!"]
    rows = [(c, rng.choice([None, t, t, t + 1]), rng.choice(roles), rng.choice(texts)) for c in [*range(30), None] for t in range(rng.randrange(1, 5))]
    got, turns, sums = repaired(spark, rows)
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        mine = [(t, role if role is not None else " ", text if text is not None else " ") for c, t, role, text in rows if c == conv]
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
        marks = faults([x[1:] for x in mine])
        cost, audit, lines = least(marks)
        known = [t for t, _, _ in mine if t is not None]
        assert (r["cost"], r["audit"]) == (cost, audit)
        assert r["gaps"] == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert [r[f] for f in ("blank", "duplicate", "truncated")] == [sum(m[2] == f for m in marks) for f in ("blank", "duplicate", "truncated")]
        assert r["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        mine = sorted((t for t in turns if t["conv"] == conv), key=lambda t: t["place"])
        assert [f"{t['role']}:{t['text']}" for t in mine] == lines and [t["place"] for t in mine] == list(range(len(lines)))
        assert sums.get(conv, sha("")) == sha("\n".join(lines))


def test_repair_of_a_long_conversation_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "system"]), rng.choice(["Yes.", "No", f"Turn {t}.", ""])) for t in range(700)] + [(2, 0, "user", "Hi.")]
    one, turns, sums = repaired(spark, rows)
    monkeypatch.setattr(repair, "BLOCK", 16)
    monkeypatch.setattr(repair, "FAN", 4)
    assert repaired(spark, rows)[0] == one
    assert sha("\n".join(f"{t['role']}:{t['text']}" for t in sorted(turns, key=lambda t: t["place"]) if t["conv"] == 1)) == sums[1]
    assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in sorted(turns, key=lambda t: t["place"]) if t["conv"] == 1))


def test_repair_of_nothing_and_of_clashing_columns(spark):
    assert repaired(spark, []) == ({}, [], {})
    rows = spark.createDataFrame([(1, 0, "user", "Hi.")], CONVS).withColumns({c: F.lit(7) for c in ("nth", "key", "block", "fault", "cost", "audit", "kind", "digest")})
    found = repair.repairs(rows, Workspace(spark, "t"))
    assert found.select("cost", "audit").collect() == [(3, "KI")] and repair.repaired(rows, found).count() == 2


def test_damage_is_by_the_hash_of_conversation_and_turn(spark):
    rows = [(c, t, "assistant", "One. Two?") for c in (1, 2, None) for t in [*range(40), None]]
    got = {(r["conv"], r["turn"]): r for r in repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).groupBy("conv", "turn").agg(F.count("*").alias("n"), F.min("role").alias("role"), F.min("text").alias("text")).collect()}
    kinds = set()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        kinds.add(kind)
        r = got.get((c, t))
        assert (r is None) == (kind == 0)
        if r:
            assert (r["n"], r["role"], r["text"]) == (2 if kind == 3 else 1, "user" if kind == 4 else role, {1: "", 2: "One Two"}.get(kind, text))
    assert {0, 1, 2, 3, 4} <= kinds


# 12 manifest


def tree(leaves):
    """Root, and for each leaf its steps (left, right), of hashes in order."""
    steps, nodes = [[] for _ in leaves], [(h, [k]) for k, h in enumerate(leaves)]
    while len(nodes) > 1:
        up = []
        for i in range(0, len(nodes), 8):
            run = nodes[i : i + 8]
            for k, (_, under) in enumerate(run):
                for leaf in under:
                    steps[leaf].append(("".join(h for h, _ in run[:k]), "".join(h for h, _ in run[k + 1 :])))
            up.append((sha("".join(h for h, _ in run)), [x for _, under in run for x in under]))
        nodes = up
    return nodes[0][0], steps


def test_manifest_equals_trees_by_hand(spark):
    rng = random.Random(4)
    langs = [None, "", "de", "en", "zz", "ä", "Z", "en-GB", "e", "f"]
    rows = [(rng.choice([None, *range(40)]), rng.choice(langs), sha(str(rng.randrange(200)))) for _ in range(300)] + [(k, "en", sha(f"en{k}")) for k in range(600)] + [(1, "one", sha("1"))]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").withColumns({c: F.lit("clash") for c in ("tree", "h", "idx", "steps", "root", "up", "extra")})
    got = merkle.manifest(df, "lang", ["doc_id"], Workspace(spark, "t"))
    assert {"extra", "subroot", "root", "steps"} <= set(got.columns)
    by = {}
    for d, lang, h in rows:
        by.setdefault(lang, []).append((d is not None, d or 0, h))
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: tree([h for *_, h in sorted(by[lang])]) for lang in by}
    root, tops = tree([trees[lang][0] for lang in order])
    wanted = sorted(repr((lang, h, trees[lang][0], root, steps + tops[order.index(lang)])) for lang in by for (_, _, h), steps in zip(sorted(by[lang]), trees[lang][1]))
    assert sorted(repr((r["lang"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["steps"]])) for r in got.collect()) == wanted
    checked = got.select(merkle.folded(F.col("leaf"), F.col("steps")).alias("a"), merkle.verified(F.sha2(F.col("leaf"), 256), F.col("steps"), F.col("root")).alias("b"))
    assert checked.distinct().collect() == [(root, False)]


def test_manifest_of_one_row_and_of_none(spark):
    one = merkle.manifest(spark.createDataFrame([(1, None, "ab")], "doc_id long, lang string, leaf string"), "lang", ["doc_id"], Workspace(spark, "t")).collect()
    assert [(r["subroot"], r["root"], r["steps"]) for r in one] == [("ab", "ab", [])]
    none = merkle.manifest(spark.createDataFrame([], "doc_id long, lang string, leaf string"), "lang", ["doc_id"], Workspace(spark, "t"))
    assert none.count() == 0


def test_leaves_tell_nulls_from_texts_and_fields_apart(spark):
    rows = [("a", "b"), ("ab", ""), (None, "ab"), ("-", "ab"), ("ä", "1:b"), ("ä1:", "b")]
    df = spark.createDataFrame(rows, "a string, b string")
    part = lambda x: "-" if x is None else f"{len(x.encode())}:{x}"
    assert [r[0] for r in df.select(merkle.leaf(F.col("a"), F.col("b"))).collect()] == [sha(part(a) + part(b)) for a, b in rows]
    assert len({r[0] for r in df.select(merkle.leaf(F.col("a"), F.col("b"))).collect()}) == len(rows)


def test_op12_on_odd_documents(spark, tmp_path):
    rows = [(k, f"Text {k}", "en", "s", 6) for k in range(20)] + [(None, "No Id", None, None, None), (3, "text 3", "de", "s", 6), (3, "Text 3", "en", "s", 6), (7, None, "fr", None, 0), (8, "", "fr", "ä", 0), (9, "X" * 200000, "fr", "s", 200000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("leaf", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op12_merkle(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and len({r["root"] for r in got}) == 1
    for r in got:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        texts = [t for d, t, *_ in rows if d == r["doc_id"]]
        if not hit:
            assert r["verified"]
        elif all(t and t != t.lower() for t in texts):
            assert not r["verified"]
        elif all(t is None or t == t.lower() for t in texts):
            assert r["verified"]


# 13 decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOW))


def by_hand(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(len(w), size)
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (owners := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= owners
        out.append((doc, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return out


def decontaminated(spark, docs, items, size=10, clash=()):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in clash})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in clash})
    return [tuple(r) for r in contamination.contaminated(d, i, Workspace(spark, "t"), contamination.Windows(words=size)).collect()]


@pytest.mark.parametrize("size", [1, 2, 5, 10])
def test_decontamination_equals_brute_force(spark, size):
    rng = random.Random(size)
    word = lambda: rng.choice(["a", "b", "C", "é", "1", "ñu", "Ab", "x9"])
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "-", "\x00"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 9, 10, 11, 14]))) for k in range(20)] + [(3, text(12)), (None, text(4)), (50, None), (51, ""), (52, " ..! "), (53, "a"), (54, "a A a a a a a a a a a a a")]
    docs = [(k, text(rng.choice([0, 1, 9, 10, 60, 200])) + rng.choice([items[k % 20][1], "", ""]) + text(5)) for k in range(60)]
    docs += [docs[0], (None, docs[1][1]), (None, None), (70, ""), (71, "..."), (72, "a " * 3000), (73, items[0][1] * 200), (1, "other text")]
    got = decontaminated(spark, docs, items, size, ("h", "th", "place", "body", "n", "key", "items", "set"))
    assert sorted(map(repr, got)) == sorted(map(repr, by_hand(docs, items, size)))


def test_decontamination_of_empty_tables(spark):
    assert decontaminated(spark, [], [(1, "a b")]) == []
    assert decontaminated(spark, [(1, "a b")], []) == [(1, 2, 0, 0, [], False)]


def test_hits_are_of_whole_words_and_stay_in_one_text(spark):
    items = [(1, "one two three four five six seven eight nine ten")]
    docs = [(1, "one two three four five six seven eight nine tenth"), (2, "five six seven eight nine ten"), (3, "one two three four"), (4, "zero One, two. THREE four-five six seven eight nine TEN eleven"), (5, "six seven eight nine ten one two three four five")]
    assert sorted(decontaminated(spark, docs, items)) == by_hand(docs, items) and by_hand(docs, items)[3][2:] == (10, 1, ["1"], True)


def test_prefix_is_the_rarest_shingle(spark):
    windows = contamination.item_windows(spark.createDataFrame([(1, "the cat sat on the mat")], "item_id long, text string"), contamination.Windows(words=6, shingle=2)).cache()
    assert windows.count() == 5
    counts = windows.select("h", F.when(F.col("at") == 3, 2).otherwise(9).cast("long").alias("docs"))
    assert contamination.prefixes(windows, counts).select("at", "n", "body").collect() == [(3, 6, "the cat sat on the mat")]
    assert contamination.prefixes(windows, counts.where("docs > 2")).count() == 0
    assert windows.select("h").distinct().count() == 5
