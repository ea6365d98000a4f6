"""Line dedup by content-defined chunks of lines.

Each line that is not blank has a hash, and a line is a boundary if its hash is the least of two neighbours, its own and
that of the line before or after it. So two lines in a row hold the same boundary wherever they stand and whatever is
around them, about a third of all lines are none, and a document's boundaries shift with its lines. A boundary that
occurs only once in the corpus ends there. Those that are repeated grow by a line to each side on which they are the
lesser one: a chunk of two lines, with a hash rolled over theirs and the blank lines between. A chunk that occurs more
than once anywhere in the corpus is removed but for its first occurrence, after its bytes are compared with the first
one's; chunks overlap, and repeated ones that touch are together the whole repeated passage.

Chunks that end where a rolling hash of several lines says so would be fewer, but a boundary inside a short run, or one
that depends on a line outside of it, leaves no whole chunk in it. Here every repeated run of two or more lines is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, filled, mix64, slices, table

#: Of the hash that is rolled over a chunk's lines: odd factors of a line and of what is between two lines.
FACTOR, BETWEEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BOUNDARY = "doc_id long, th long, v long, start long, stop long, before long, begins long, after long, ends long"


def boundaries(texts: list[bytes]) -> list[np.ndarray]:
    """Columns text, v, start, stop, before, begins, after, ends of the boundaries of some texts: which text, the line's hash and
    its bytes (line end included); the hash of the chunk with the line before and where that begins; the same after.
    A chunk that belongs to its other line has a hash of -1 here; of two equal lines the first is the lesser."""
    owner, hashes, start, stop, between = [], [], [], [], []
    for k, data in enumerate(texts):
        at = 0
        for line in data.split(b"\n"):
            end = min(at + len(line) + 1, len(data))
            if line.strip(b" \t\r"):
                between.append(xxhash.xxh3_64_intdigest(data[stop[-1] : at]) if owner and owner[-1] == k and stop[-1] < at else 0)
                owner.append(k)
                hashes.append(xxhash.xxh3_64_intdigest(line))
                start.append(at)
                stop.append(end)
            at = end
    h, gap = np.array(hashes, np.uint64), np.array(between, np.uint64)
    owner, start, stop = (np.array(x, np.int64) for x in (owner, start, stop))
    pair = mix64((mix64(h[:-1] * FACTOR + gap[1:] * BETWEEN) + h[1:]) * FACTOR).view(np.int64)
    same, first = owner[1:] == owner[:-1], h[:-1] <= h[1:]
    after, before = np.full(len(h), -1, np.int64), np.full(len(h), -1, np.int64)
    after[:-1][same & first] = pair[same & first]
    before[1:][same & ~first] = pair[same & ~first]
    begins, ends = np.append(start[:1], start[:-1]), np.append(stop[1:], stop[-1:])
    at = np.flatnonzero((after != -1) | (before != -1))
    return [x[at] for x in (owner, h.view(np.int64), start, stop, before, begins, after, ends)]


def boundary_rows(docs: DataFrame) -> DataFrame:
    """BOUNDARY rows of rows doc_id, th, text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                owner, *found = boundaries(filled(part.column("text")).cast(pa.large_binary()).to_pylist())
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("th").take(take), *map(pa.array, found)], names)

    names = [c.split()[0] for c in BOUNDARY.split(", ")]
    return docs.mapInArrow(run, BOUNDARY)


def chunks(docs: DataFrame, work: Workspace) -> DataFrame:
    """(doc_id, th, h1, h2, start, stop) of the chunks at boundaries that occur more than once; start and stop in bytes."""
    found = work.write(boundary_rows(docs), "boundaries")
    repeated = work.write(found.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("v"), "repeated")
    side = lambda h, start, stop: F.struct(F.col(h).alias("h2"), F.col(start).alias("start"), F.col(stop).alias("stop"))
    grown = found.join(repeated, "v", "left_semi").select("doc_id", "th", F.col("v").alias("h1"), F.explode(F.array(side("before", "begins", "stop"), side("after", "start", "ends"))).alias("s"))
    return work.write(grown.where("s.h2 <> -1").select("doc_id", "th", "h1", "s.*"), "chunks")


def deduplicated_lines(docs: DataFrame, work: Workspace) -> DataFrame:
    """All rows and columns of docs, with the text less its repeated chunks, and the counts lines_removed and
    bytes_removed (longs; columns of these names are replaced).

    The first occurrence is that of the least doc_id (null first), then the least hash of the text, then the first in
    the text; a repeat in the same text goes too, even where the two overlap. Rows that agree in doc_id and text are one
    document: their chunks are no repeats of each other. Null texts stay null; texts without repeats keep their bytes.
    Blank lines inside a repeated chunk go with it, those around it stay. A text of which all is removed becomes empty.
    Each different line stays at least once. Chunks whose hashes are those of a first chunk with other bytes stay.
    Very long texts are one row as any other. doc_id is an integer column.
    """
    made = ("lines_removed", "bytes_removed")
    rest = [c for c in docs.columns if c not in made]
    base = docs.select(*(F.col(f"`{c}`") for c in rest), F.xxhash64("text").alias("__th"))
    own = base.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__th").alias("th"), "text")
    found = chunks(own.where("text IS NOT NULL"), work)
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "th", "start")
    several = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select("h1", "h2", "first")
    several = work.write(several, "several")
    hit = found.join(several, ["h1", "h2"]).withColumn("is_first", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")) & (F.col("start") == F.col("first.start")))
    spans = hit.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "stop", "h1", "h2", "is_first")).alias("spans"))
    spans = work.write(spans, "spans")

    raw = F.col("text").cast("binary")
    pieces = (
        own.join(spans.withColumnsRenamed({"doc_id": "d", "th": "t"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
        .select("doc_id", "th", raw.alias("raw"), F.explode("spans").alias("s"))
        .select("doc_id", "th", "s.*", F.substring("raw", F.col("s.start") + 1, (F.col("s.stop") - F.col("s.start")).cast("int")).alias("piece"))
    )
    bare = F.when(F.substring("piece", -1, 1) == F.lit(b"\n"), F.expr("substring(piece, 1, length(piece) - 1)")).otherwise(F.col("piece"))
    pieces = pieces.withColumn("piece", bare)
    firsts = pieces.where("is_first").select("h1", "h2", F.col("piece").alias("first_piece"))
    repeats = pieces.where("NOT is_first").join(firsts, ["h1", "h2"]).where("piece = first_piece")
    cuts = repeats.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("__cuts")).withColumnsRenamed({"doc_id": "__d", "th": "__t"})
    joined = base.join(cuts, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t")), "left")

    # cuts that overlap begin where the one before stops
    before = F.concat(F.array(F.lit(0).cast("long")), F.col("__cuts.stop"))
    apart = F.zip_with("__cuts", F.slice(before, 1, F.size("__cuts")), lambda c, b: F.struct(F.greatest(c["start"], b).alias("start"), c["stop"].alias("stop")))
    joined = joined.withColumn("__cuts", apart)

    # what stays: from each cut's stop to the next one's start
    stops = F.concat(F.array(F.lit(0).cast("long")), F.col("__cuts.stop"))
    starts = F.concat(F.col("__cuts.start"), F.array(F.octet_length("text").cast("long")))
    part = lambda whole, a, b: F.substring(whole, (a + 1).cast("int"), (b - a).cast("int"))
    kept = F.transform(F.array(raw), lambda whole: F.array_join(F.zip_with(stops, starts, lambda a, b: part(whole, a, b).cast("string")), ""))[0]
    gone = lambda whole: F.aggregate(F.col("__cuts"), F.lit(0).cast("long"), lambda n, c: n + F.size(F.split(F.regexp_replace(part(whole, c["start"], c["stop"]).cast("string"), "\n$", ""), "\n", -1)))
    cut = F.col("__cuts").isNotNull()
    return joined.select(
        *(F.when(cut, kept).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in rest),
        F.when(cut, F.transform(F.array(raw), gone)[0]).otherwise(F.lit(0)).cast("long").alias("lines_removed"),
        F.when(cut, F.aggregate("__cuts", F.lit(0).cast("long"), lambda n, c: n + c["stop"] - c["start"])).otherwise(F.lit(0)).cast("long").alias("bytes_removed"),
    )


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated_lines(docs, Workspace(spark, "lines"))


#: A repeated run of two or more lines is one all of whose pairs of adjacent lines are repeated; blank lines belong to the line before them.
OP7_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL
), f AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13)) <> '' AS filled, max(k) OVER (PARTITION BY doc_id) AS lines FROM l
), g AS (
  SELECT *, sum(filled::INT) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM f
), b AS (
  SELECT doc_id, g, string_agg(line, chr(10) ORDER BY k) AS body, any_value(line) FILTER (filled) AS head FROM g WHERE g > 0 GROUP BY doc_id, g
), c AS (
  SELECT doc_id, g, body || chr(10) || lead(head) OVER (PARTITION BY doc_id ORDER BY g) AS chunk FROM b
), r AS (
  SELECT doc_id, g, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, g) > 1 AS repeated FROM c WHERE chunk IS NOT NULL
), t AS (
  SELECT g.*, coalesce(own.repeated, FALSE) OR (filled AND coalesce(before.repeated, FALSE)) AS gone
  FROM g LEFT JOIN r own ON own.doc_id = g.doc_id AND own.g = g.g LEFT JOIN r before ON before.doc_id = g.doc_id AND before.g = g.g - 1
), s AS (
  SELECT doc_id, string_agg(line || CASE WHEN k = lines THEN '' ELSE chr(10) END, '' ORDER BY k) FILTER (NOT gone) AS text,
         count(*) FILTER (gone) AS lines_removed, coalesce(sum(strlen(line) + (k < lines)::INT) FILTER (gone), 0)::BIGINT AS bytes_removed FROM t GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(s.text, '') END AS text,
       coalesce(lines_removed, 0) AS lines_removed, coalesce(bytes_removed, 0) AS bytes_removed
FROM documents d LEFT JOIN s USING (doc_id)
"""
