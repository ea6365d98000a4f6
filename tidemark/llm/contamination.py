"""Benchmark decontamination by a prefix-filtered join of word shingles.

An item is cut into windows of words, a window into overlapping shingles. Shingles are ordered by rarity: in how many
documents they are. Where a window occurs, all of its shingles do, so the join needs one of them, the rarest: it is the
window's prefix. Documents give the places of prefix shingles with a few words around, and what joins is kept if the
window fits at that place between the text's first and last word (position and length) and all of its words are there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, buffers, mix64, slices, table
from tidemark.llm.shingles import BASE, LOWER, word_hashes

#: Bytes between words: ASCII but digits and letters.
APART = np.ones(256, bool)
APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: log2 of the bits of the filter of item shingles that tasks hold: 8 MB, however many items there are. What it lets through by chance does not join.
FILTER_BITS = 26
#: Bits of one bitmap of Spark's.
BITMAP = 1 << 15


@dataclass(frozen=True)
class Windows:
    """words: of a window; an item of fewer words is one window. shingle: words of a shingle; a window of fewer is one shingle."""

    words: int = 10
    shingle: int = 3


class _Text:
    """The words of some texts: their hashes, which text each is of, and their bytes with one space between."""

    def __init__(self, column: pa.Array):
        raw, bounds = buffers(column)
        keep = ~APART[raw]
        start = keep.copy()
        start[1:] &= ~keep[:-1]
        edges = bounds[:-1][bounds[:-1] < len(raw)]
        start[edges] = keep[edges]
        self.hashes, self.owner = word_hashes(raw, bounds, APART)
        at = np.flatnonzero(keep)
        first = np.flatnonzero(start[at])
        # word k's bytes are at first[k] + k, after k spaces
        self.begin = first + np.arange(len(first))
        self.end = np.append(first[1:], len(at))[: len(first)] + np.arange(len(first))
        self.clean = np.full(len(at) + len(first), 0x20, np.uint8)
        self.clean[np.arange(len(at)) + (np.cumsum(start[at]) - 1 if len(at) else 0)] = LOWER[raw[at]].astype(np.uint8)
        self.clean = self.clean.tobytes()
        self.counts = np.bincount(self.owner, minlength=len(bounds) - 1)
        self.base = np.cumsum(self.counts) - self.counts

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each run of `width` words of one text, and the place of its first word among all."""
        n = max(0, len(self.hashes) - width + 1)
        rolled = np.full(n, width, np.uint64)
        for k in range(width):
            rolled = mix64(rolled * np.uint64(BASE) + self.hashes[k : k + n])
        at = np.flatnonzero(self.owner[:n] == self.owner[width - 1 : width - 1 + n])
        return rolled[at], at

    def words(self, start: int, stop: int) -> bytes:
        return self.clean[self.begin[start] : self.end[stop - 1]]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x).astype(np.uint64).view(np.int64) if len(x) else np.zeros(0, np.int64))


def item_windows(items: DataFrame, w: Windows) -> DataFrame:
    """(item, n, body, at, h): of rows item_id, text each window's words, and its shingles with their places in it.

    item: the id as a string; a null id is the empty string, and rows of one id are one item."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                ids, t = part.column("item_id").to_pylist(), _Text(part.column("text"))
                widths = {k: dict(zip(at.tolist(), h.view(np.int64).tolist())) for k in range(1, w.shingle + 1) for h, at in [t.shingles(k)]}
                rows = []
                for item, n, base in zip(ids, t.counts.tolist(), t.base.tolist()):
                    size = min(n, w.words)
                    for start in range(base, base + n - size + 1 if n else base):
                        body, k = t.words(start, start + size).decode(), min(size, w.shingle)
                        rows += [(item, size, body, p, widths[k][start + p]) for p in range(size - k + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows) if rows else [[]] * 5, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64()))], ["item", "n", "body", "at", "h"])

    given = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return given.mapInArrow(run, "item string, n int, body string, at int, h long")


def bit_filter(hashes: DataFrame, column: str = "h") -> np.ndarray:
    """A bit for each value of the low FILTER_BITS bits of a hash. The bits are set in the executors; the driver gets them as
    bitmaps of 4 KB, 8 MB together at most."""
    bit = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = hashes.select(F.shiftright(bit, 15).alias("bucket"), bit.bitwiseAND(F.lit(BITMAP - 1)).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    found = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in rows:
        found[r["bucket"] * (BITMAP // 8) : (r["bucket"] + 1) * (BITMAP // 8)] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return found


def _among(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    low = hashes & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1


def document_counts(docs: DataFrame, bits: np.ndarray, widths: list[int]) -> DataFrame:
    """(h, docs): in how many documents each shingle that the filter lets through is; counted in each task before the shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                t, found = _Text(part.column("text")), [np.zeros(0, np.uint64)]
                for k in widths:
                    h, at = t.shingles(k)
                    hit = _among(h, held.value)
                    h, owner = h[hit], t.owner[at[hit]]
                    order = np.lexsort((h, owner))
                    h, owner = h[order], owner[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                    found.append(h[new])
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([_long(values), pa.array(counts.astype(np.int64))], ["h", "docs"])

    return docs.select("text").mapInArrow(run, "h long, docs long").groupBy("h").agg(F.sum("docs").alias("docs"))


def _places(docs: DataFrame, bits: np.ndarray, widths: list[int], w: Windows) -> DataFrame:
    """Of rows doc_id, th, text: a row with n_words for each document, and one for each place of a shingle that the filter
    lets through: h, its place, and the words that a window around it can have with the place of the first of these."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                t, n = _Text(part.column("text")), part.num_rows
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(t.counts), none, none, none, pa.nulls(n, pa.string())], names)
                found = [(k, h[hit], at[hit]) for k in widths for h, at in [t.shingles(k)] for hit in [_among(h, held.value)]]
                for k, h, at in found:
                    # a few thousand at a time: each carries some words
                    for i in range(0, len(at), 4096):
                        here = at[i : i + 4096]
                        owner = t.owner[here]
                        low = np.maximum(t.base[owner], here - (w.words - k))
                        high = np.minimum(t.base[owner] + t.counts[owner], here + w.words)
                        around = [t.words(a, b).decode() for a, b in zip(low.tolist(), high.tolist())]
                        take = pa.array(owner)
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(take), part.column("th").take(take), pa.nulls(len(here), pa.int64()), _long(h[i : i + 4096]), pa.array(here - t.base[owner]), pa.array(low - t.base[owner]), pa.array(around, pa.string())], names
                        )

    names = ["doc_id", "th", "n_words", "h", "place", "low", "around"]
    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, n_words long, h long, place long, low long, around string")


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(h, at, n, body): of each different window its rarest shingle, ties by hash and place. A window one of whose shingles is
    in no document occurs in none and goes."""
    distinct = windows.select("n", "body", "at", "h").distinct()
    ranked = distinct.join(counts, "h", "left").groupBy("n", "body").agg(F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "h", "at")).alias("first"))
    return ranked.where("first.docs > 0").select("first.h", "first.at", "n", "body")


def occurrences(docs: DataFrame, items: DataFrame, work: Workspace, w: Windows | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: sizes (doc_id, th, n_words), a row for each row of docs; hits (doc_id, th, start, stop, body), each place
    where a window occurs once; windows (item, body), which items have it.

    docs: doc_id long, text; items: item_id, text. Words are runs of characters other than ASCII signs and controls, A-Z
    lower-cased. Rows that agree in doc_id and text are one document here (th: a hash of the text). Null and empty texts and
    texts of signs alone have no words; an item without words has no window. start and stop in words.
    """
    w = w or Windows()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    windows = work.write(item_windows(items, w), "windows")
    # short items make shingles of fewer words; texts are read for the widths that are there
    widths = [r[0] for r in windows.select(F.least("n", F.lit(w.shingle))).distinct().collect()]
    counts = work.write(document_counts(keyed, bit_filter(windows), widths), "counts")
    first = work.write(prefixes(windows, counts), "prefixes")
    places = work.write(_places(keyed, bit_filter(first), widths, w), "places")
    near = places.where("h IS NOT NULL").distinct().join(first, "h")
    start = F.col("place") - F.col("at")
    inside = F.slice(F.split("around", " "), (start - F.col("low") + 1).cast("int"), F.col("n"))
    # position: not before the first word; length: not after the last one, where the slice is short
    fits = near.where(start >= F.col("low")).where(F.array_join(inside, " ") == F.col("body"))
    hits = fits.select("doc_id", "th", start.alias("start"), (start + F.col("n")).alias("stop"), "body")
    return places.where("n_words IS NOT NULL").select("doc_id", "th", "n_words"), work.write(hits, "hits"), windows.select("item", "body").distinct()


def contaminated(docs: DataFrame, items: DataFrame, work: Workspace, w: Windows | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated): a row for each row of docs; items as a sorted array of strings.

    Items with the same windows in a document come by the documents' sets of windows, each of which is looked up once however
    many copies have it, and windows with the same items are one.
    """
    sizes, hits, windows = occurrences(docs, items, work, w)
    # windows that the same items have stand for each other
    owners = work.write(windows.join(hits.select("body").distinct(), "body", "left_semi").groupBy("body").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("set", F.sha2(F.to_json(F.struct("items")), 256)), "owners")
    spans = hits.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(s["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], s["stop"]).alias("reach")), lambda a: a["n"])
    sets = hits.join(owners.select("body", "set"), "body").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("set")).alias("sets"))
    sets = work.write(sets.withColumn("key", F.sha2(F.array_join("sets", ""), 256)), "sets")
    each = sets.select("key", "sets").distinct().select("key", F.explode("sets").alias("set")).join(owners.select("set", "items").distinct(), "set").select("key", F.explode("items").alias("item"))
    named = each.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = spans.select("doc_id", "th", covered.alias("n_hit")).withColumn("__key", F.struct("doc_id", "th")).drop("doc_id", "th")
    found = found.join(sets.select(F.struct("doc_id", "th").alias("__key"), "key"), "__key").join(named, "key")
    out = sizes.withColumn("__key", F.struct("doc_id", "th")).join(work.write(found.select("__key", "n_hit", "items"), "found"), "__key", "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = contaminated(docs, items, Workspace(spark, "contamination"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL
), v AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS body
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS k, doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS w FROM documents
), p AS (
  SELECT k, s, n, array_to_string(w[s : s + n - 1], ' ') AS body FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT n FROM v) l WHERE len(w) >= n)
), h AS (
  SELECT k, s, n, item FROM p JOIN v USING (n, body)
), c AS (
  SELECT k, count(*) AS n_hit FROM (SELECT DISTINCT k, unnest(range(s, s + n)) AS word FROM h) GROUP BY k
), t AS (
  SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h) GROUP BY k
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)
"""
