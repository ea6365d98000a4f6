"""Balanced selection of documents under quotas: picks in rounds, each over the whole table."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.files import folder

# Scores of the selection.
TAG_POINTS, TAGS_AT_MOST, LONG_POINTS, MEDIUM_POINTS, SHORT_POINTS = 1000, 3, 200, 100, 50
FIELD_POINTS, RARE_TAG_POINTS, LENGTH_PENALTY, COVERED_BY = 500, 300, 100, 2
BUCKET_POINTS = {"long": LONG_POINTS, "medium": MEDIUM_POINTS, "short": SHORT_POINTS}


@dataclass(frozen=True)
class Quotas:
    """total: documents to select; stages: at most so many of each; lengths: of each bucket, beyond which one costs points;
    includes: ids that are in from the start; tags: to be covered twice, and fields: once; swaps: at most for tags that none
    has. lowest_first picks the least score and the greatest slug instead of the greatest score and the least slug."""

    total: int
    stages: dict[str, int]
    lengths: dict[str, int]
    tags: tuple[str, ...]
    fields: tuple[str, ...] = ()
    includes: tuple = ()
    swaps: int = 3
    lowest_first: bool = False


def static_score(tags, bucket):
    """The part of a document's score that no earlier pick changes."""
    return F.least(tags, F.lit(TAGS_AT_MOST)) * TAG_POINTS + F.when(bucket == "long", LONG_POINTS).when(bucket == "medium", MEDIUM_POINTS).otherwise(SHORT_POINTS)


#: Documents that a round of picks looks at.
ROUND = 64


class _Selection:
    """The picks so far and what they cover: as many documents as are selected, and a counter for each stage, length, tag and
    field. The documents themselves stay in their table; each look at it is an aggregate of its best rows, by a score that has the counters as literals."""

    def __init__(self, table: DataFrame, q: Quotas):
        self.table, self.q, self.taken = table, q, {}
        self.stages, self.lengths, self.tags, self.fields = Counter(), Counter(), Counter(), set()

    def add(self, row: dict, how: str) -> None:
        self.taken[row["id"]] = (row, how)
        self._count(row, 1)
        self.fields |= set(row["fields"])

    def _count(self, row: dict, by: int) -> None:
        self.stages[row["stage"]] += by
        self.lengths[row["bucket"]] += by
        self.tags.update({t: by for t in set(row["tags"]) & set(self.q.tags)})

    def drop(self, ident) -> None:
        self._count(self.taken.pop(ident)[0], -1)

    def full(self, bucket: str) -> bool:
        return self.lengths[bucket] >= self.q.lengths.get(bucket, 0)

    @property
    def rare(self) -> list[str]:
        return [t for t in self.q.tags if self.tags[t] < COVERED_BY]

    def value(self, row: dict, penalty: bool) -> int:
        tags = set(row["tags"])
        found = min(len(tags), TAGS_AT_MOST) * TAG_POINTS + FIELD_POINTS * len((set(row["fields"]) & set(self.q.fields)) - self.fields) + RARE_TAG_POINTS * len(tags & set(self.rare))
        found += 0 if self.full(row["bucket"]) else BUCKET_POINTS[row["bucket"]]
        # the penalty is taken from the negated score where the least is preferred
        return found + (LENGTH_PENALTY if penalty and self.full(row["bucket"]) else 0) * (1 if self.q.lowest_first else -1)

    def _value(self, penalty: bool) -> Column:
        """value() of a row of the table."""
        among = lambda c, names: F.size(F.array_intersect(c, F.array(*map(F.lit, names)))) if names else F.lit(0)
        late = LENGTH_PENALTY * (1 if self.q.lowest_first else -1) if penalty else 0
        points = F.lit(0)
        for bucket, own in BUCKET_POINTS.items():
            points = F.when(F.col("bucket") == bucket, late if self.full(bucket) else own).otherwise(points)
        return F.least(F.size("tags"), F.lit(TAGS_AT_MOST)) * TAG_POINTS + among("fields", [f for f in self.q.fields if f not in self.fields]) * FIELD_POINTS + among("tags", self.rare) * RARE_TAG_POINTS + points

    def _left(self) -> DataFrame:
        return self.table.where(~F.col("id").isin(*self.taken)) if self.taken else self.table

    def _first(self, rows: DataFrame, penalty: bool, n: int) -> list[dict]:
        """The n best rows, of which each task keeps n at most."""
        slug = F.desc("slug") if self.q.lowest_first else F.asc("slug")
        value = F.asc("__value") if self.q.lowest_first else F.desc("__value")
        return [r.asDict() for r in rows.withColumn("__value", self._value(penalty)).orderBy(value, slug, "id").limit(n).collect()]

    def greedy(self) -> None:
        """Picks in rounds. No pick raises a score, so a row that was not among the best of a round is not above its last one
        later either: rows of the round that still are can be picked without another look. Where the least score is
        preferred, that does not hold, and a round is one pick."""
        key = lambda r: (-self.value(r, True), r["slug"], r["id"])
        open_ = lambda stage: self.stages[stage] < self.q.stages.get(stage, 0)
        n = 1 if self.q.lowest_first else ROUND
        while len(self.taken) < self.q.total and (stages := [s for s in self.q.stages if open_(s)]):
            found = self._first(self._left().where(F.col("stage").isin(*stages)), True, n)
            if not found:
                return
            edge, picked = key(found[-1]) if len(found) == n else None, False
            while len(self.taken) < self.q.total and (fits := [r for r in found if r["id"] not in self.taken and open_(r["stage"])]):
                best = min(fits, key=key)
                if picked and edge is not None and key(best) > edge:
                    break
                self.add(best, "picked")
                picked = True

    def cover(self) -> None:
        """For each tag that fewer than two have: the best document with it takes the place of the last one."""
        for tag in sorted(self.q.tags):
            if self.tags[tag] < COVERED_BY and (found := self._first(self._left().where(F.array_contains("tags", tag)), False, 1)):
                if self.taken:
                    self.drop(next(reversed(self.taken)))
                self.add(found[0], "covers")

    def swap(self) -> None:
        """For the first tags that none has: the document with the most tags, of these the shortest, takes the place of one
        whose tags are all had by others, the one with the most common ones, of these the longest; or else of the longest."""
        for tag in [t for t in sorted(self.q.tags) if not self.tags[t]][: self.q.swaps]:
            count = F.size(F.array_intersect("tags", F.array(*map(F.lit, self.q.tags))))
            having = self._left().where(F.array_contains("tags", tag)).orderBy(count.desc(), "tokens", "id").limit(1).collect()
            if not having or not self.taken:
                continue
            known = lambda r: set(r["tags"]) & set(self.q.tags)
            rows = [r for r, _ in self.taken.values()]
            spare = [r for r in rows if all(self.tags[t] > 1 for t in known(r))]
            if spare:
                old = min(spare, key=lambda r: (-sum(self.tags[t] for t in known(r)), -r["tokens"], r["id"]))
            else:
                old = min(rows, key=lambda r: (-r["tokens"], r["id"]))
            self.drop(old["id"])
            self.add(having[0].asDict(), "swapped")


def select_balanced(docs: DataFrame, q: Quotas) -> DataFrame:
    """(id, stage, bucket, pick, how) of the selection from docs (id, slug, stage, bucket, tokens, tags, fields).

    The picks depend on each other, so they are made one after the other, each by an aggregate over all documents, of which
    the driver sees the best few: a round is ROUND rows, the result q.total. Rows with a null id cannot be picked. Null
    tags and fields count as none, and lengths that are not known as short.
    """
    none = F.array().cast("array<string>")
    bucket = F.when(F.col("bucket").isin(*BUCKET_POINTS), F.col("bucket")).otherwise("short")
    narrow = docs.where("id IS NOT NULL").select("id", "slug", "stage", bucket.alias("bucket"), "tokens", *(F.array_distinct(F.coalesce(c, none)).alias(c) for c in ("tags", "fields")))
    path = folder(docs.sparkSession, "selection")
    narrow.write.parquet(path)
    chosen = _Selection(docs.sparkSession.read.schema(narrow.schema).parquet(path), q)
    if q.includes:
        for row in chosen.table.where(F.col("id").isin(*q.includes)).orderBy("id").collect():
            chosen.add(row.asDict(), "included")
    chosen.greedy()
    chosen.cover()
    chosen.swap()
    found = [(r["id"], r["stage"], r["bucket"], k, how) for k, (r, how) in enumerate(chosen.taken.values(), 1)]
    return docs.sparkSession.createDataFrame(found, "id long, stage string, bucket string, pick long, how string")
