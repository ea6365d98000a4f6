"""Repair of conversation structure: the cheapest edits that make the turns' roles follow a grammar.

Nodes of the lattice are (turn index, grammar state). Keeping, reroling and deleting lead to the next index, inserting to
another state of the same one. Edges are made as Dijkstra's search goes, with (cost, audit) as its priority, where the
audit is the letters of the edits so far; the first accepting end node that is popped ends it. A letter leads from a
state to one other, so paths with equal audits are the same path, none of two equally cheap ones to a node is the
beginning of the other, and the least key of a node gives the least keys of what follows it.

A long conversation is searched in blocks of turns, from each state to each state, and blocks are joined by the least
sum of costs, ties by the joined audits, until one is left; a conversation in one block is one search from the start.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Workspace, numbered, sql_crc32, table

# The grammar (s?(ua)+)? of role initials. States: 0 start, 1 after a system turn, 2 after a user's, 3 after an assistant's.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that a rerole or an insert gives in each state, and the state after it.
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
ACCEPTING = (0, 3)
LEGAL = ("su", "ua", "au")

#: Turns of a block, and blocks that are joined at a time.
BLOCK, FAN = 512, 64
SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Costs:
    """Of the edits, and of a truncated turn that stays. Keeping is free; the others cost something."""

    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


def search(codes: str, entry: int, last: bool, costs: Costs) -> dict[int, tuple[int, str]]:
    """{state: (cost, audit)} at the end of some turns, from a state before them; of the `last` ones the cheapest accepting end only.

    codes: two characters a turn: its role's initial (- for one that the grammar has not, _ for an empty role, which
    stands for nothing) and its fault (k none, t truncated, x must go)."""
    n, heap, settled, found = len(codes) // 2, [(0, "", 0, entry)], set(), {}
    while heap:
        cost, audit, i, q = heappop(heap)
        if (i, q) in settled:
            continue
        settled.add((i, q))
        if i == n:
            if last and q in ACCEPTING:
                return {q: (cost, audit)}
            if not last:  # what is inserted between two blocks is the next one's
                found[q] = (cost, audit)
                continue
        after = NEXT[q][1]
        if i < n:
            initial, fault = codes[2 * i], codes[2 * i + 1]
            heappush(heap, (cost + costs.delete, audit + "D", i + 1, q))
            if fault != "x":
                more = costs.truncated if fault == "t" else 0
                kept = q if initial == "_" else MOVES.get((q, initial))
                if kept is not None:
                    heappush(heap, (cost + more, audit + "K", i + 1, kept))
                if kept != after:
                    heappush(heap, (cost + more + costs.rerole, audit + "R", i + 1, after))
        heappush(heap, (cost + costs.insert, audit + "I", i, after))
    return found


def joined(left: list[dict], right: list[dict]) -> list[dict]:
    """Paths (entry, exit, cost, audit) through two blocks in a row: of each entry and exit the least."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for a in left:
        for b in right:
            if a["exit"] == b["entry"]:
                key, value = (a["entry"], b["exit"]), (a["cost"] + b["cost"], a["audit"] + b["audit"])
                best[key] = min(best.get(key, value), value)
    return [dict(entry=e, exit=x, cost=c, audit=s) for (e, x), (c, s) in best.items()]


def marked(rows: DataFrame, work: Workspace) -> DataFrame:
    """(conv, turn, initial, fault, nth) of rows conv, turn, role, text: a written table.

    Turns go by turn (null first), role and the text's SHA-256; equal rows are turns of their own. fault: blank (nothing but
    ASCII white space), duplicate (role and text are an earlier turn's of the conversation), truncated (the last other
    character is not . ! or ?) or none; the first of these that holds. Null roles and texts count as one space.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("none")
    initial = F.substring("role", 1, 1)
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    narrow = rows.select("conv", "turn", space("role").alias("role"), space("text").alias("text")).select(
        "conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), F.when(initial == "", "_").when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"), fault.alias("fault")
    )
    nth = work.write(numbered(work.write(narrow, "turns"), work, ["conv"], ["turn", "role", "digest"], "nth"), "numbered")
    said = F.struct("conv", "role", "digest")
    several = nth.where("fault <> 'blank'").groupBy(said.alias("said")).agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("said", "first")
    again = nth.withColumn("said", said).join(work.write(several, "several"), "said", "left")
    return work.write(again.select("conv", "turn", "initial", F.when((F.col("fault") != "blank") & (F.col("nth") > F.col("first")), "duplicate").otherwise(F.col("fault")).alias("fault"), "nth"), "marked")


PATHS = "array<struct<entry:int,exit:int,cost:bigint,audit:string>>"


def _blocks(turns: DataFrame, sizes: DataFrame, work: Workspace, costs: Costs) -> DataFrame:
    """(key, block, head, tail, illegal, paths): a row a conversation, of all its turns."""
    code = F.struct("nth", F.concat("initial", F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", "t").otherwise("k")).alias("code"))
    block = F.floor((F.col("nth") - 1) / BLOCK)
    cut = turns.groupBy(F.struct("conv").alias("key"), block.alias("block")).agg(F.array_join(F.array_sort(F.collect_list(code))["code"], "").alias("codes"))
    cut = cut.join(sizes.select(F.struct("conv").alias("key"), F.floor((F.col("turns") - 1) / BLOCK).alias("last")), "key")
    schema = T.StructType([*cut.select("key", "block").schema.fields, *(T.StructField(c, T.StringType()) for c in ("head", "tail")), T.StructField("illegal", T.LongType()), T.StructField("paths", T._parse_datatype_string(PATHS))])
    kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))

    def solve(batches):
        for batch in batches:
            out = []
            for k, last, codes in zip(batch.column("block").to_pylist(), batch.column("last").to_pylist(), batch.column("codes").to_pylist()):
                initials = codes[::2]
                paths = [dict(entry=e, exit=q, cost=c, audit=a) for e in ((0, 1, 2, 3) if k else (0,)) for q, (c, a) in search(codes, e, k == last, costs).items()]
                out.append((initials[0], initials[-1], sum(x + y not in LEGAL for x, y in zip(initials, initials[1:])), paths))
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*out) if out else [[]] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), *columns], schema.names)

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        rows = group.select(["head", "tail", "illegal", "paths"]).to_pylist()
        whole = rows[0]
        for r in rows[1:]:
            whole = dict(head=whole["head"], tail=r["tail"], illegal=whole["illegal"] + r["illegal"] + (whole["tail"] + r["head"] not in LEGAL), paths=joined(whole["paths"], r["paths"]))
        columns = [pa.array([whole[c]], kind) for c, kind in zip(("head", "tail", "illegal", "paths"), kinds)]
        return pa.Table.from_arrays([group.column("key").slice(0, 1), pa.array([group.column("block")[0].as_py() // FAN], pa.int64()), *columns], names=schema.names)

    found = work.write(cut.mapInArrow(solve, schema), "blocks")
    while (found.agg(F.max("block")).first()[0] or 0) > 0:
        found = work.write(found.withColumn("up", F.floor(F.col("block") / FAN)).groupBy("key", "up").applyInArrow(lambda g: join(g.drop_columns("up")), schema), "joined")
    return found


def repairs(rows: DataFrame, work: Workspace, costs: Costs | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each conversation of rows conv, turn, role,
    text; a written table. `rows` is read twice.

    gaps: turns that lack between the least and the greatest, nulls aside. illegal: neighbours whose role initials are not
    su, ua or au. audit: a letter an edit (Keep, Rerole, Delete, Insert), in order. A null conv is a conversation. Columns
    of other names are not read.
    """
    turns = marked(rows, work)
    distinct = F.countDistinct("turn")
    sizes = turns.groupBy("conv").agg(
        F.max("nth").alias("turns"), F.coalesce(F.max("turn") - F.min("turn") + 1 - distinct, F.lit(0)).cast("long").alias("gaps"), *(F.count_if(F.col("fault") == c).alias(c) for c in ("blank", "duplicate", "truncated"))
    )
    sizes = work.write(sizes, "sizes")
    found = _blocks(turns, sizes, work, costs or Costs())
    best = F.array_min(F.transform("paths", lambda p: F.struct(p["cost"].alias("cost"), p["audit"].alias("audit"))))
    whole = sizes.withColumn("key", F.struct("conv")).join(found.select("key", "illegal", best.alias("best")), "key")
    return work.write(whole.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit"), "repairs")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, place, edit, turn, role, text): the turns of the repaired conversations, places from 0; an inserted turn has a null
    turn and an empty text. found: what repairs() gives for the same rows.

    A conversation's audit and then its turns pass through one task, sorted, a batch at a time: the output of a conversation is in
    order within its partition, so that it can be hashed as it comes, and no task holds its texts.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    said = rows.select("conv", F.lit(1).alias("kind"), "turn", space("role").alias("role"), space("text").alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    plan = found.select("conv", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(b"").alias("digest"))
    order = ["conv", "kind", "turn", "role", "digest"]
    schema = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("turn", rows.schema["turn"].dataType), *(T.StructField(c, T.StringType()) for c in ("role", "text"))])

    def run(batches):
        conv, audit, at, place, q = None, "", 0, 0, 0
        for batch in batches:
            out = []

            def inserted():
                nonlocal at, place, q
                while audit[at : at + 1] == "I":
                    role, q = NEXT[q]
                    out.append((conv, place, "I", None, role, ""))
                    at, place = at + 1, place + 1

            for c, kind, turn, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "kind", "turn", "role", "text"))):
                inserted()
                if kind == 0:
                    conv, audit, at, place, q = c, text, 0, 0, 0
                    continue
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    role, q = NEXT[q]
                elif role:
                    q = MOVES[q, role[0]]
                out.append((conv, place, edit, turn, role, text))
                place += 1
            if batch.num_rows:
                kinds = [batch.schema.field("conv").type, pa.int64(), pa.string(), batch.schema.field("turn").type, pa.string(), pa.string()]
                last = kinds
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*out) if out else [[]] * 6, kinds)], schema.names)
        out = []
        while audit[at : at + 1] == "I":
            role, q = NEXT[q]
            out.append((conv, place, "I", None, role, ""))
            at, place = at + 1, place + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*out), last)], schema.names)

    return said.unionByName(plan).repartition("conv").sortWithinPartitions(*order).mapInArrow(run, schema)


def hashed(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of `role:text` of each turn, joined by newlines: of rows that come in order, a conversation at a time."""
    import hashlib

    schema = T.StructType([turns.schema["conv"], T.StructField("sha256", T.StringType())])

    def run(batches):
        now, conv, kind = None, None, None
        for batch in batches:
            out, kind = [], batch.schema.field("conv").type
            for c, place, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "place", "role", "text"))):
                if place == 0:
                    if now is not None:
                        out.append((conv, now.hexdigest()))
                    conv, now = c, hashlib.sha256()
                else:
                    now.update(b"\n")
                now.update(f"{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out])], schema.names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([now.hexdigest()])], schema.names)

    return turns.select("conv", "place", "role", "text").mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) of conversations whose turns are dropped, emptied, cut of their ends, repeated or given to
    the user, by a hash of conv_id and turn. Nulls count as one space, but in conv_id and turn themselves."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    hurt = rows.select(F.col("conv_id").alias("conv"), "turn", F.when(kind == 4, "user").otherwise(name("role")).alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    return hurt.withColumn("again", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))).select("conv", "turn", "role", "text")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation of the table, damaged and repaired; one that has lost all turns has zeros and an empty audit."""
    rows, work = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), Workspace(spark, "repair")
    hurt = damaged(rows)
    found = repairs(hurt, work)
    sums = work.write(hashed(repaired(hurt, found)), "hashes")
    key = lambda c: F.struct(F.col(c).alias("conv")).alias("key")
    whole = rows.select("conv_id").distinct().select("conv_id", key("conv_id")).join(found.withColumn("key", key("conv")).drop("conv"), "key", "left").join(sums.select(key("conv"), "sha256"), "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return whole.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_KIND = sql_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
#: The same least paths by steps over the turns: before each turn and at the end at most two inserts help.
OP11_SQL = f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_KIND} % 20 AS kind FROM conversations
), x AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS again FROM k WHERE kind <> 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM x
), f AS MATERIALIZED (
  SELECT *, left(role, 1) AS initial, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault,
         count(*) OVER (PARTITION BY conv_id) AS size, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n
), ins AS (
  SELECT * FROM (VALUES (0, 0, 0, '', ''), (0, 2, 3, 'I', 'user:' || chr(10)), (0, 3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 1, 0, '', ''), (1, 2, 3, 'I', 'user:' || chr(10)), (1, 3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
    (2, 2, 0, '', ''), (2, 3, 3, 'I', 'assistant:' || chr(10)), (3, 3, 0, '', ''), (3, 2, 3, 'I', 'user:' || chr(10))) v(q, p, cost, audit, body)
), dp AS (
  SELECT DISTINCT conv_id, size, 0::BIGINT AS i, 0 AS q, {{'c': 0, 'a': '', 'b': ''}} AS m FROM f UNION ALL
  SELECT conv_id, size, i, q, min(m) AS m FROM (
    SELECT dp.conv_id, dp.size, dp.i + 1 AS i,
           CASE e WHEN 'D' THEN p WHEN 'R' THEN CASE WHEN fault IN ('k', 't') THEN CASE WHEN p = 2 THEN 3 ELSE 2 END END
             ELSE CASE WHEN fault IN ('b', 'd') THEN NULL WHEN initial = '' THEN p WHEN p = 0 AND initial = 's' THEN 1 WHEN p <> 2 AND initial = 'u' THEN 2 WHEN p = 2 AND initial = 'a' THEN 3 END END AS q,
           {{'c': dp.m.c + ins.cost + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 't' THEN 3 ELSE 0 END, 'a': dp.m.a || ins.audit || e,
             'b': dp.m.b || ins.body || CASE e WHEN 'D' THEN '' WHEN 'R' THEN CASE WHEN p = 2 THEN 'assistant:' ELSE 'user:' END || text || chr(10) ELSE role || ':' || text || chr(10) END}} AS m
    FROM dp JOIN ins ON ins.q = dp.q JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 CROSS JOIN (VALUES ('D'), ('K'), ('R')) edits(e)
  ) WHERE q IS NOT NULL GROUP BY conv_id, size, i, q
), best AS (
  SELECT dp.conv_id, min({{'c': dp.m.c + ins.cost, 'a': dp.m.a || ins.audit, 'b': dp.m.b || ins.body}}) AS m FROM dp JOIN ins ON ins.q = dp.q WHERE dp.i = dp.size AND ins.p IN (0, 3) GROUP BY dp.conv_id
), s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(m.c, 0)::BIGINT AS cost, coalesce(m.a, '') AS audit, sha256(coalesce(left(m.b, -1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""
