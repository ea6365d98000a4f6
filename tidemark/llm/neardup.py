"""Near-duplicate documents by a chosen-path set similarity join.

Documents with equal shingle sets are one class from the start. Classes are branched in independent trees: at each
node a keyed hash chooses minwise functions, and a class goes to one child for each, by its minwise token there. A
branch ends in a node of few classes, or in one that no longer shrinks and so holds a dense group.

First each class is compared with its likeliest partner in each of its last nodes and with a hub there, a class that
many may be linked with, which finds most components with a number of links in proportion to the classes. Then all pairs of a node that may be linked and have different
components yet are compared; of a dense group these are pairs with a class outside its main component, in blocks. So no
group's pairs are all emitted, and no link between components is left out. Sketches choose what is compared; every
link is confirmed on full shingle sets.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import GOLDEN, Workspace, buffers, mix64, slices, table
from tidemark.llm.components import connected_components
from tidemark.llm.shingles import Signatures, shingle_sets

SKETCH = tuple(f"s{j}" for j in range(8))
#: Two bits of each minwise value: the low ones are in the first half of the sketch, the high ones in the other.
PLANES = tuple(zip(SKETCH[:4], SKETCH[4:]))
HASHES = 256
NODE = "node long, id long, n int, up int, " + ", ".join(f"{s} long" for s in SKETCH)
COLUMNS = ("id", "n", *SKETCH)


@dataclass(frozen=True)
class ChosenPath:
    """percent: links have 100 * intersection >= percent * union. recall: the share of pairs at just that similarity that
    the trees find at least; trees and branch (functions a node) follow from both unless they are given. With 128 minwise
    tokens and trees of up to 8 levels, 80 percent and 0.9999 need 4 trees of 2 functions, which lose such a pair with a
    chance of 5.5e-5; likelier pairs are lost less. limit: classes of a node that
    is compared whole; more are branched, up to `levels` deep, or until at level dense_from or below a node has more than half of its
    parent's classes. chunk: classes of a dense node that are compared to find likely partners; block: classes of a side in a
    task that compares the rest of a dense group, and block_shingles: shingles of them, about."""

    width: int = 5
    percent: int = 80
    recall: float = 0.9999
    trees: int | None = None
    branch: int | None = None
    limit: int = 32
    levels: int = 8
    dense_from: int = 3
    chunk: int = 256
    block: int = 256
    block_shingles: int = 1 << 20
    tokens: int = 128
    seed: int = 1

    def __post_init__(self):
        if self.branch is None:
            # a pair that stays together in one and a half children on average hardly ever dies out
            object.__setattr__(self, "branch", max(2, math.ceil(150 / self.percent)))
        if self.trees is None:
            object.__setattr__(self, "trees", next(t for t in count(1) if missed(self, t) <= 1 - self.recall))


def missed(p: ChosenPath, trees: int) -> float:
    """The chance that a pair at the limit is together in no node of the last level of any tree: it agrees in a binomial
    number of its tokens, of which each node of each tree chooses; a node with its last children loses it if all do."""
    share, found = p.percent / 100, 0.0
    for k in range(p.tokens + 1):
        lost = 0.0
        for _ in range(p.levels):
            lost = (1 - k / p.tokens * (1 - lost)) ** p.branch
        found += math.comb(p.tokens, k) * share**k * (1 - share) ** (p.tokens - k) * lost**trees
    return found


def least_agreement(p: ChosenPath) -> int:
    """How many sketch places agree at least where similarity is `percent`: four and a half deviations below the mean, which
    a pair at that limit misses with a chance of 3 in a million."""
    share = p.percent / 100 + (1 - p.percent / 100) / 4
    return int(HASHES * share - 4.5 * (HASHES * share * (1 - share)) ** 0.5)


def profiles(docs: DataFrame, p: ChosenPath) -> DataFrame:
    """(doc_id, n, k1, k2, tokens, s0..s7): of each row its set's size, its 128-bit key, minwise tokens and sketch."""
    names = ["doc_id", "n", "k1", "k2", "tokens", *SKETCH]

    def run(batches):
        signatures = Signatures(HASHES, p.tokens, p.seed)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingle_sets(*buffers(part.column("text")), p.width)
                tokens, bits = zip(*(signatures.of(s) if len(s) else (b"", bytes(64)) for s in sets))
                k1 = np.array([mix64(s + np.uint64(GOLDEN)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                k2 = np.array([mix64(s ^ np.uint64(GOLDEN)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                s = np.frombuffer(b"".join(bits), np.int64).reshape(-1, 8)
                n = pa.array([len(x) for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, pa.array(k1), pa.array(k2), pa.array(tokens, pa.binary()), *(pa.array(s[:, j].copy()) for j in range(8))], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, tokens binary, " + ", ".join(f"{s} long" for s in SKETCH))


def _children(node: np.ndarray, tokens: np.ndarray, p: ChosenPath):
    """The child nodes of each row, one array for each of the functions that the node chooses."""
    n = np.uint64(p.tokens)
    first = mix64(node + np.uint64(GOLDEN)) % n
    step = mix64(node ^ np.uint64(GOLDEN))
    for j in range(p.branch):
        chosen = first if j == 0 else (first + np.uint64(1) + (step + np.uint64(j - 1)) % (n - np.uint64(1))) % n
        token = tokens[np.arange(len(node)), chosen.astype(np.int64)].astype(np.uint64)
        yield mix64(mix64(node + chosen + np.uint64(1)) ^ (token * np.uint64(GOLDEN)))


def _expand(rows: DataFrame, p: ChosenPath, root: bool) -> DataFrame:
    """The next level's NODE rows, of rows with COLUMNS, tokens and, below the roots, node and size."""

    def run(batches):
        roots = mix64(np.arange(1, p.trees + 1, dtype=np.uint64) * np.uint64(GOLDEN) + np.uint64(p.seed))
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(size, p.tokens)
            nodes = [np.full(size, r) for r in roots] if root else [batch.column("node").to_numpy().view(np.uint64)]
            up = pa.array(np.full(size, 2**31 - 1, np.int32)) if root else batch.column("size")
            for node in nodes:
                for child in _children(node, tokens, p):
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("id"), batch.column("n"), up, *(batch.column(x) for x in SKETCH)], ["node", "id", "n", "up", *SKETCH])

    return rows.select(*(() if root else ("node", "size")), *COLUMNS, "tokens").mapInArrow(run, NODE)


def _groups(batches, key: tuple[str, ...], names: tuple[str, ...]):
    """Arrays of whole groups, of batches whose rows are sorted by their group's key."""
    held = None
    for batch in batches:
        x = {c: batch.column(c).to_numpy() for c in names}
        if held is not None:
            x = {c: np.concatenate([held[c], x[c]]) for c in x}
        if not len(x["id"]):
            continue
        last = np.ones(len(x["id"]), bool)
        for c in key:
            last &= x[c] == x[c][-1]
        cut = int(np.argmax(last))
        held = {c: v[cut:] for c, v in x.items()}
        if cut:
            yield {c: v[:cut] for c, v in x.items()}
    if held is not None and len(held["id"]):
        yield held


def _alike(x: dict, i: np.ndarray, j: np.ndarray, p: ChosenPath) -> tuple[np.ndarray, np.ndarray]:
    """Agreeing sketch places of the rows i and j, and whether these and their sizes allow a link."""
    differ = lambda s: x[s][i].view(np.uint64) ^ x[s][j].view(np.uint64)
    same = HASHES - sum(np.bitwise_count(differ(s) | differ(t)).astype(np.int32) for s, t in PLANES)
    lo, hi = np.minimum(x["n"][i], x["n"][j]).astype(np.int64), np.maximum(x["n"][i], x["n"][j]).astype(np.int64)
    return same, (100 * lo >= p.percent * hi) & (x["id"][i] != x["id"][j]) & (same >= least_agreement(p))


def _hubs(group: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each row a hub among its partners or itself; -1 for rows without. group: of each row, in order; i, j: the pairs.

    Of each group the row with the most partners that have no hub yet becomes the hub of these, until every row with a
    partner has one or is one. A group around one text thus gets one hub, and as many links as rows."""
    size = len(group)
    hub = np.full(size, -1)
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    while len(a):
        degree = np.bincount(a, minlength=size)
        order = np.lexsort((-np.arange(size), degree, group))
        last = order[np.append(np.diff(group[order]) != 0, True)]
        top = last[degree[last] > 0]
        is_top = np.zeros(size, bool)
        is_top[top] = True
        hub[top] = np.where(hub[top] < 0, top, hub[top])
        reached = is_top[a]
        hub[b[reached]] = np.where(hub[b[reached]] < 0, a[reached], hub[b[reached]])
        # pairs whose second row has a hub do not count for the first one's degree any more
        left = hub[b] < 0
        a, b = a[left], b[left]
    return hub


def _likeliest(rows: DataFrame, p: ChosenPath, key: tuple[str, ...]) -> DataFrame:
    """(a, b): each class with the one of its group whose sketch agrees most, and with its hub, if a link is possible."""

    def run(batches):
        for x in _groups(batches, key, (*key, *COLUMNS)):
            size = len(x["id"])
            change = np.zeros(size, bool)
            for c in key:
                change[1:] |= x[c][1:] != x[c][:-1]
            group = np.cumsum(change)
            best, partner, first, second = np.zeros(size, np.int32), np.full(size, -1), [], []
            for k in range(1, size):
                i = np.arange(size - k)
                i = i[group[i] == group[i + k]]
                if not len(i):
                    break
                same, ok = _alike(x, i, i + k, p)
                i, same = i[ok], same[ok]
                first.append(i)
                second.append(i + k)
                for one, other in ((i, i + k), (i + k, i)):
                    more = same > best[one]
                    best[one[more]], partner[one[more]] = same[more], other[more]
            if not first:
                continue
            hub = _hubs(group, np.concatenate(first), np.concatenate(second))
            for found in (partner, hub):
                one = np.flatnonzero((found >= 0) & (found != np.arange(size)))
                a, b = x["id"][one], x["id"][found[one]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return rows.select(*key, *COLUMNS).repartition(*key).sortWithinPartitions(*key, "id").mapInArrow(run, "a long, b long")


def _crossing(rows: DataFrame, p: ChosenPath) -> DataFrame:
    """(a, b): pairs of a node that may be linked, of different components (column part)."""

    def run(batches):
        for x in _groups(batches, ("node",), ("node", "part", *COLUMNS)):
            size = len(x["id"])
            for k in range(1, size):
                i = np.arange(size - k)
                i = i[x["node"][i] == x["node"][i + k]]
                if not len(i):
                    break
                i = i[x["part"][i] != x["part"][i + k]]
                i = i[_alike(x, i, i + k, p)[1]]
                if len(i):
                    a, b = x["id"][i], x["id"][i + k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return rows.select("node", "part", *COLUMNS).repartition("node").sortWithinPartitions("node", "id").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, p: ChosenPath) -> DataFrame:
    """(a, b, common, total): sizes of intersection and union of the pairs' full sets. b's text is fetched first, so that of a much-compared a is not shuffled with each pair."""

    def run(batches):
        kept: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def set_of(text: str) -> np.ndarray:
            raw = np.frombuffer(text.encode(), np.uint8)
            if (found := kept.get(text)) is None:
                found = kept[text] = shingle_sets(raw, np.array([0, len(raw)]), p.width)[0]
                if len(kept) > 16:
                    kept.popitem(last=False)
            return found

        for batch in batches:
            common, total = [], []
            for ta, tb in zip(batch.column("ta"), batch.column("tb")):
                x, y = set_of(ta.as_py()), shingle_sets(raw := np.frombuffer(tb.as_py().encode(), np.uint8), np.array([0, len(raw)]), p.width)[0]
                both = len(np.intersect1d(x, y, assume_unique=True))
                common.append(both)
                total.append(len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "common", "total"])

    with_b = pairs.select("a", "b").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    with_a = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return with_a.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, common long, total long")


def _blocked(rows: DataFrame, work: Workspace, fields: tuple[str, ...], p: ChosenPath) -> DataFrame:
    """rows (main, part, COLUMNS) twice: those outside their family's main component once for each block of all rows
    (asks), and all rows once for each block of those outside; (main, ob, gb) is a pair of blocks. A block has about
    p.block rows and p.block_shingles shingles."""
    weight = F.greatest(F.lit(1.0) / p.block, F.col("n") / p.block_shingles)
    outside = F.col("part") != F.col("main")
    counts = rows.groupBy("main").agg(F.ceil(F.sum(weight)).cast("int").alias("all"), F.ceil(F.sum(F.when(outside, weight))).cast("int").alias("out")).where("out > 0")
    rows = rows.join(work.write(counts, "counts"), "main")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = rows.where(outside).select(*fields, own("out").alias("ob"), each("all").alias("gb"), F.lit(True).alias("asks"))
    return asked.unionByName(rows.select(*fields, each("out").alias("ob"), own("all").alias("gb"), F.lit(False).alias("asks")))


def _family_links(family: DataFrame, texts: DataFrame, work: Workspace, p: ChosenPath) -> DataFrame:
    """(a, b): links of classes outside a family's main component with classes of the family.

    family (main, part, COLUMNS): the classes of all dense nodes with one main component. Those outside it are a query
    set against all of the family: both are cut into blocks, and a task compares two blocks and returns links only. This
    is done by sketches alone at first, which says what classes may have a link of another component at all; only these
    and their texts are then compared on full sets, by sketch before. So a task holds two blocks' texts, however large the family.
    """
    fields = ("main", "part", *COLUMNS)

    def likely(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        x = {c: table.column(c).to_numpy() for c in ("part", *COLUMNS)}
        members, hit = np.flatnonzero(~asks), np.zeros(len(asks), bool)
        for k in np.flatnonzero(asks).tolist():
            near = members[x["part"][members] != x["part"][k]]
            near = near[_alike(x, np.full(len(near), k), near, p)[1]]
            hit[near] = True
            hit[k] = len(near) > 0
        found = np.flatnonzero(hit)
        return pa.table({"main": table.column("main").take(found), "id": pa.array(x["id"][found])})

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        x = {c: table.column(c).to_numpy() for c in ("part", *COLUMNS)}
        text, sets = table.column("text"), {}

        def set_of(k: int) -> np.ndarray:
            if k not in sets:
                raw = np.frombuffer(text[k].as_py().encode(), np.uint8)
                sets[k] = shingle_sets(raw, np.array([0, len(raw)]), p.width)[0]
            return sets[k]

        a, b = [], []
        members = np.flatnonzero(~asks)
        for k in np.flatnonzero(asks).tolist():
            near = members[(x["part"][members] != x["part"][k])]
            near = near[_alike(x, np.full(len(near), k), near, p)[1]]
            joined: set[int] = set()
            for j in near.tolist():
                if x["part"][j] in joined:
                    continue
                s, t = set_of(k), set_of(j)
                common = int((s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t).sum())
                if 100 * common >= p.percent * (len(s) + len(t) - common):
                    joined.add(x["part"][j])
                    a.append(min(x["id"][k], x["id"][j]))
                    b.append(max(x["id"][k], x["id"][j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    pair = ("main", "ob", "gb")
    found = _blocked(family, work, fields, p).groupBy(*pair).applyInArrow(likely, "main long, id long")
    found = work.write(found.distinct(), "may-link")
    left = work.write(family.join(found, ["main", "id"]).join(texts, "id"), "left")
    return _blocked(left, work, (*fields, "text"), p).groupBy(*pair).applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, work: Workspace, p: ChosenPath | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs.

    Null, empty and blank texts have an empty set and are linked with nothing. Rows that share a doc_id count as one
    document: a link of one is a link of both, and both are kept or neither. Rows with a null doc_id get the
    component of the documents with an equal set, if any has a doc_id; else null, and they are kept. Of a group the
    least doc_id stays, so ties cannot be. Columns but doc_id (an integer) and text are not read. An empty table gives no rows.
    """
    p = p or ChosenPath()
    rows = work.write(profiles(docs, p), "profiles")
    link = F.expr(f"100 * common >= {p.percent} * total")
    any_of = [F.max(c).alias(c) for c in ("tokens", *SKETCH)]
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.max("n").cast("int").alias("n"), *any_of)
    classes = work.write(classes.where("id IS NOT NULL"), "classes")

    small, dense = [], []
    made = _expand(classes, p, True)
    for depth in range(1, p.levels + 1):
        made = work.write(made, "nodes")
        sizes = work.write(made.groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("size")).where("size > 1"), "sizes")
        sized = work.write(made.join(sizes, "node"), "sized")
        work.drop(made)
        small.append(sized.where(F.col("size") <= p.limit))
        large = sized.where(F.col("size") > p.limit)
        stops = F.lit(depth == p.levels) | (F.lit(depth >= p.dense_from) & (2 * F.col("size") > F.col("up")))
        dense.append(large.where(stops))
        large = large.where(~stops)
        if depth == p.levels or large.isEmpty():
            break
        made = _expand(large.join(classes.select("id", "tokens"), "id"), p, False)
    small, dense = reduce(DataFrame.unionByName, small), reduce(DataFrame.unionByName, dense)
    salted = dense.withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / p.chunk)).cast("int"))
    likely = _likeliest(small.withColumn("salt", F.lit(0)).unionByName(salted), p, ("node", "salt"))
    likely = work.write(likely.distinct(), "likely")

    needed = likely.select(F.explode(F.array("a", "b")).alias("id")).unionByName(dense.select("id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).where("id IS NOT NULL")
    texts = work.write(texts.join(work.write(needed, "needed"), "id"), "texts")
    links = work.write(_verified(likely, texts, p).where(link).select("a", "b"), "links")
    parts = work.write(connected_components(links, work), "parts")

    with_part = lambda nodes: nodes.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    in_dense = work.write(with_part(dense), "dense")
    counted = in_dense.groupBy("node", "part").agg(F.count(F.lit(1)).alias("size"))
    main = work.write(counted.groupBy("node").agg(F.max_by("part", F.struct("size", "part")).alias("main")), "main")
    family = in_dense.join(main, "node").select("main", "part", *COLUMNS).distinct()
    found = [_family_links(work.write(family, "family"), texts, work, p)]
    crossing = work.write(_crossing(with_part(small), p).distinct(), "crossing")
    found.append(_verified(crossing.join(likely, ["a", "b"], "left_anti"), texts, p).where(link).select("a", "b"))
    found = work.write(reduce(DataFrame.unionByName, found).distinct(), "found")
    if not found.isEmpty():
        # links of components, which are few, and then each class by its component's; a class without links is its own
        known = parts.select(F.col("id").alias("a"), F.col("component").alias("ca"))
        ends = found.join(known, "a", "left").join(known.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        joined = work.write(connected_components(ends, work).select(F.col("id").alias("component"), F.col("component").alias("whole")), "joined")
        moved = parts.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
        fresh = joined.join(parts, F.col("id") == joined["component"], "left_anti").select(F.col("component").alias("id"), F.col("whole").alias("component"))
        parts = work.write(moved.unionByName(fresh), "parts")

    of_row = rows.select("doc_id", "n", "k1", "k2").join(classes.select("k1", "k2", "id"), ["k1", "k2"], "left")
    whole = of_row.join(parts, "id", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("doc_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, work: Workspace, p: ChosenPath | None = None) -> DataFrame:
    """The rows of docs whose document is kept. Rows with a null doc_id stay."""
    found = near_duplicates(docs, work, p).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(work.write(found, "gone"), F.col("doc_id") == F.col("__gone"), "left_anti")


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, Workspace(spark, "neardup"), ChosenPath(width=2))


#: All shared shingles joined: for small tables, as a statement of the rule.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE coalesce(w, []) END AS g FROM w
), s AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS shingle FROM g
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), r AS (
  SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.reached
)
SELECT doc_id, any_value(len(g))::BIGINT AS n_shingles, min(reached) AS component_id, doc_id = min(reached) AS kept FROM g JOIN r USING (doc_id) GROUP BY doc_id
"""
