"""Merkle manifest of a dataset: a tree over the rows of each group, and one over the groups' roots.

The build goes bottom-up: each level is a written table, and runs of neighbours become the next level's nodes. Proofs go
top-down: the rows of a level join their parents, and each child sets the step of its own siblings before the steps that
its parent has inherited. A step holds what stands left and right of a node in its run, so steps alone fold a leaf to the root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, numbered, sql_crc32, table

#: Nodes in a run.
FAN = 8
STEPS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows have the same fields in a row; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


@dataclass
class Forest:
    """levels[k]: tree, idx, n (nodes of the tree on this level), h and, above level 0, the children's hashes in order.
    A tree's last level is the one with n = 1."""

    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        """(tree, h): a row a tree."""
        found = None
        for level in self.levels:
            part = level.where("n = 1").select("tree", "h")
            found = part if found is None else found.unionByName(part)
        return found

    def steps(self, inherited: DataFrame, work: Workspace, carried: tuple[str, ...] = ()) -> DataFrame:
        """The rows of level 0 with their steps to the root and the columns `carried`.

        inherited: a row a tree with the steps from its root upwards and the carried columns. Level by level, children
        join their parents; what a level's nodes inherit is written, but for level 0's, which is the result.
        """
        at = None
        for k in reversed(range(len(self.levels))):
            level = self.levels[k].drop("children")
            found = level.where("n = 1").join(inherited, "tree").select(*level.columns, "steps", *carried)
            if at is not None:
                up = at.select("tree", F.col("idx").alias("up"), "children", F.col("steps").alias("above"), *carried)
                below = level.where("n > 1").withColumn("up", F.floor(F.col("idx") / FAN)).join(up, ["tree", "up"])
                nth = F.pmod("idx", F.lit(FAN)).cast("int")
                side = lambda first, size: F.array_join(F.slice("children", first, size), "")
                own = F.struct(side(F.lit(1), nth).alias("left"), side(nth + 2, F.lit(FAN)).alias("right"))
                found = found.unionByName(below.select(*level.columns, F.concat(F.array(own), "above").alias("steps"), *carried))
            if k == 0:
                return found
            children = self.levels[k].select("tree", "idx", "children")
            at = work.write(found.select("tree", "idx", "steps", *carried).join(children, ["tree", "idx"]), f"steps-{k}")
        raise ValueError("a forest has a level at least")


def forest(rows: DataFrame, order: list[str], work: Workspace) -> Forest:
    """Trees over rows (tree, h and others), in each tree by `order`, nulls first; rows that tie are interchangeable if `order` holds h.

    Rows are numbered by ranges, and a node's key is its tree and its place in it, so a tree with most of the rows is
    many tasks on each level but the last ones, which have a few rows.
    """
    sized = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    first = numbered(rows, work, ["tree"], order, "idx").withColumn("idx", F.col("idx") - 1).join(sized, "tree")
    levels = [work.write(first, "level-0")]
    while levels[-1].where("n > 1").limit(1).count():
        under = levels[-1].where("n > 1").select("tree", F.floor(F.col("idx") / FAN).alias("idx"), F.ceil(F.col("n") / FAN).alias("n"), F.struct("idx", "h").alias("child"))
        nodes = under.groupBy("tree", "idx", "n").agg(F.array_sort(F.collect_list("child"))["h"].alias("children"))
        levels.append(work.write(nodes.select("tree", "idx", "n", F.sha2(F.array_join("children", ""), 256).alias("h"), "children"), f"level-{len(levels)}"))
    return Forest(levels)


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its steps give."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof(steps: Column) -> Column:
    """The hashes of all siblings, from the leaf's to the root's, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(rows: DataFrame, group: str, order: list[str], work: Workspace) -> DataFrame:
    """rows (with a column `leaf`), with group root `subroot`, `root` and `steps` from each leaf to the root.

    One tree a group over its leaves by `order` and then the leaf, nulls first; one tree over the groups' roots, by group
    in the order of its bytes, null first. A tree of one leaf is that leaf. Rows that are equal in all columns are leaves
    of their own. An empty table has no rows and no root. Columns named tree, h, idx, n, steps, subroot and root are
    replaced; `rows` is read several times, so it should be a written table.
    """
    made = ("tree", "h", "idx", "n", "children", "steps", "subroot", "root", "up", "above")
    rest = [c for c in rows.columns if c not in made]
    # a group's name as a key that is never null; the empty key is before all others
    keyed = rows.select(F.coalesce(F.concat(F.lit(":"), F.col(f"`{group}`").cast("string")), F.lit("")).alias("tree"), F.col("leaf").alias("h"), *(F.col(f"`{c}`") for c in rest))
    below = forest(keyed, [*order, "h"], work)
    roots = work.write(below.roots(), "roots")
    above = forest(roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "h"), ["group"], work)
    top = above.roots().select("tree", F.array().cast(STEPS).alias("steps"), F.col("h").alias("root"))
    groups = above.steps(top, work, ("root",))
    inherited = work.write(groups.select(F.col("group").alias("tree"), "steps", F.col("h").alias("subroot"), "root"), "groups")
    return below.steps(inherited, work, ("subroot", "root")).select(*(F.col(f"`{c}`") for c in rest), "subroot", "root", "steps")


def verified(start: Column, steps: Column, root: Column) -> Column:
    return folded(start, steps) == root


def _lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows are tampered with after the manifest is made; their leaves no longer fold to the root, if the text held capitals.

    Nulls in any column are dashes; rows with a null doc_id come first and are not tampered with. Rows of one lang and
    doc_id stand by their leaves.
    """
    docs, work = table(spark, sf_dir, "documents"), Workspace(spark, "merkle")
    now = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0, F.lit(False))
    lowered = _lowered(F.col("text"))
    changed = hit & ~F.col("text").eqNullSafe(lowered)
    leaves = docs.select("doc_id", "lang", leaf(*now, F.col("text")).alias("leaf"), F.when(changed, leaf(*now, lowered)).alias("forged"))
    leaves = work.write(leaves, "leaves")
    whole = manifest(leaves, "lang", ["doc_id"], work)
    fold = folded(F.coalesce("forged", "leaf"), F.col("steps"))
    out = whole.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("steps")), 256).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_levels(name: str, source: str, count: int) -> str:
    """Levels 0 to count of a forest as CTEs, each with what is left and right of a node in its run."""
    beside = "coalesce(string_agg(h, '') OVER (PARTITION BY tree, idx // 8 ORDER BY idx ROWS BETWEEN {}), '')"
    parts = []
    for k in range(count + 1):
        under = f"SELECT tree, idx, n, h FROM {source}" if k == 0 else f"SELECT tree, idx // 8 AS idx, (any_value(n) + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY idx)) AS h FROM {name}{k - 1} WHERE n > 1 GROUP BY tree, idx // 8"
        parts.append(f"{name}{k} AS (SELECT *, {beside.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {beside.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM ({under}))")
    every = " UNION ALL ".join(f"SELECT tree, h FROM {name}{k} WHERE n = 1" for k in range(count + 1))
    return ", ".join(parts) + f", {name}_roots AS ({every})"


def _sql_fold(name: str, count: int, start: str) -> tuple[str, str]:
    """The proof and the folded hash over the joined levels {name}0.. of one tree."""
    proof_sql, fold = [], start
    for k in range(count):
        step = f"coalesce({name}{k}.n, 0) > 1"
        proof_sql.append(f"CASE WHEN {step} THEN {name}{k}.l || {name}{k}.r ELSE '' END")
        fold = f"CASE WHEN {step} THEN sha256({name}{k}.l || ({fold}) || {name}{k}.r) ELSE ({fold}) END"
    return " || ".join(proof_sql), fold


def _sql(levels: int = 7, groups: int = 3) -> str:
    """levels, groups: of the trees over documents and over langs; 8 to that power is what a tree may hold."""
    enc = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low_proof, low_fold = _sql_fold("a", levels, "coalesce(d.forged, d.h)")
    joins = " ".join(f"LEFT JOIN a{k} ON a{k}.tree = d.tree AND a{k}.idx = d.idx // {8**k}" for k in range(levels))
    top_proof, top_fold = _sql_fold("b", groups, "e.fold")
    ups = " ".join(f"LEFT JOIN b{k} ON b{k}.idx = g.idx // {8**k}" for k in range(groups))
    return f"""
WITH x AS (
  SELECT doc_id, coalesce(':' || lang, '') AS tree, sha256({head} || {enc("text")}) AS h,
         CASE WHEN {sql_crc32('doc_id::VARCHAR')} % 3 = 0 THEN sha256({head} || {enc(low)}) END AS forged FROM documents
), d AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM x
), {_sql_levels("a", "d", levels)},
g AS (SELECT '' AS tree, tree AS lang, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM a_roots), {_sql_levels("b", "g", groups)},
e AS (SELECT d.doc_id, d.tree, d.h, {low_proof} AS proof, {low_fold} AS fold FROM d {joins}),
f AS (SELECT e.doc_id, e.h AS leaf, g.h AS subroot, (SELECT h FROM b_roots) AS root, sha256(e.proof || {top_proof}) AS proof_sha256, {top_fold} AS folded_root
  FROM e JOIN g ON g.lang = e.tree {ups})
SELECT *, folded_root = root AS verified FROM f
"""


OP12_SQL = _sql()
