"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs.

A paragraph is hashed to a wide vector: 16 lanes that are keyed hashes of its SHA-512 and, for likeness, packed sign counts of its word
triples. A fingerprint is the sum of the vectors of all paragraphs, lanes modulo 2^32 and packed counts modulo 2^62,
so it does not depend on the order of paragraphs, and a paragraph is inserted or deleted by one addition or
subtraction (insert, delete). Two fingerprints' difference estimates how many word triples the texts do not share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, table

LANES = 16
PACKED = 18
#: Triples whose packed signs are summed before a reduction.
BLOCK = 1 << 20
#: Bits 0 and 31: two counts share a number. A text has fewer than 2^31 triples, so none runs into the other.
WIDE = 31
FIELDS = (1 << 0) | (1 << WIDE)
MODULUS = (1 << 62) - 1


def _paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _add(a: Column, b: Column, mask: int) -> Column:
    return (a + b).bitwiseAND(F.lit(mask))


def _zero() -> Column:
    return F.struct(*(F.lit(0).cast("long").alias(f"s{k}") for k in range(PACKED)), F.lit(0).cast("long").alias("n"))


def counts(text: Column) -> Column:
    """struct(s0.., n): the packed sign counts of all paragraphs' word triples, and how many triples there are.

    Sums within a block of 2^20 triples cannot reach 2^62 more than once, so only a block's sum is reduced.
    """

    def triples(paragraph):
        hashed = F.transform(F.split(paragraph, " "), lambda w: F.xxhash64(w))
        return F.transform(F.array(hashed), lambda hs: F.transform(hs, lambda h, i: F.xxhash64(h, F.get(hs, i + 1), F.get(hs, i + 2))))

    def blocks(found):
        """found: an array of one array of triples."""
        return F.flatten(F.transform(found, lambda x: F.transform(F.sequence(F.lit(0), F.size(x), F.lit(BLOCK)), lambda at: F.slice(x, at + 1, F.lit(BLOCK)))))

    def step(acc, h):
        return F.struct(*((acc[f"s{k}"] + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(FIELDS))).alias(f"s{k}") for k in range(PACKED)), (acc["n"] + 1).alias("n"))

    def reduced(acc):
        return F.struct(*(acc[f"s{k}"].bitwiseAND(F.lit(MODULUS)).alias(f"s{k}") for k in range(PACKED)), acc["n"].alias("n"))

    return F.aggregate(_paragraphs(text), _zero(), lambda acc, p: F.aggregate(blocks(triples(p)), acc, lambda sums, block: F.aggregate(block, sums, step, reduced)))


def wide(text: Column) -> Column:
    """array of 16 longs: the sums of the lanes of all paragraphs, modulo 2^32."""
    zero = F.array(*(F.lit(0).cast("long") for _ in range(LANES)))

    def lanes(p):
        return F.transform(F.array(F.sha2(p, 512)), lambda x: F.array(*(F.xxhash64(x, F.lit(k)).bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(LANES))))[0]

    return F.aggregate(_paragraphs(text), zero, lambda acc, p: F.zip_with(acc, lanes(p), lambda a, b: _add(a, b, 0xFFFFFFFF)))


def insert(lanes: Column, more: Column) -> Column:
    """The lanes of a text to which paragraphs with the lanes `more` are added."""
    return F.zip_with(lanes, more, lambda a, b: _add(a, b, 0xFFFFFFFF))


def delete(lanes: Column, less: Column) -> Column:
    """The lanes of a text of which paragraphs with the lanes `less` are taken away."""
    return F.zip_with(lanes, less, lambda a, b: (a - b + F.lit(1 << 32)).bitwiseAND(F.lit(0xFFFFFFFF)))


def fingerprint(lanes: Column, found: Column) -> Column:
    """Lower-case hex of the lanes, the packed counts and the number of triples."""
    digits = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.concat(F.array_join(F.transform(lanes, lambda x: digits(x, 8)), ""), *(digits(found[f"s{k}"], 16) for k in range(PACKED)), digits(found["n"], 8))


def _signs(found: Column) -> Column:
    """36 sums of signs, of the packed counts."""
    return F.array(*((F.lit(2) * F.shiftright(found[f"s{k}"], WIDE * j).bitwiseAND(F.lit((1 << WIDE) - 1)) - found["n"]).cast("double") for k in range(PACKED) for j in range(2)))


def likeness(a_lanes: Column, a: Column, b_lanes: Column, b: Column) -> Column:
    """0 to 1, of two fingerprints: one less the estimated squared difference of their triple counts over the sum of
    both squares. Equal fingerprints have 1; for texts of n triples that share a part p it is about p, give or take 0.16."""
    parts = F.zip_with(_signs(a), _signs(b), lambda x, y: F.struct(((x - y) * (x - y)).alias("d"), (x * x + y * y).alias("s")))
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("s"))
    ratio = F.aggregate(parts, zero, lambda acc, x: F.struct((acc["d"] + x["d"]).alias("d"), (acc["s"] + x["s"]).alias("s")), lambda t: F.try_divide(t["d"], t["s"]))
    return F.when((a_lanes == b_lanes) & (a == b), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(1 - ratio, F.lit(0.0)))))


def neighbours(light: DataFrame, work: Workspace) -> DataFrame:
    """(rid, receiver, m): each row's key, the row before it by descending doc_id (for the first row: the last), and a third of that row's characters.

    light: rid, doc_id, n_chars. Rows are dealt by ranges of doc_id and follow each other within a range; what joins the
    ranges is a table of one row for each of them.
    """
    ordered = light.repartitionByRange(F.col("doc_id").desc_nulls_last(), "rid").withColumn("part", F.spark_partition_id())
    ordered = work.write(ordered, "ordered")
    order = W.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last(), "rid")
    first = ordered.groupBy("part").agg(F.min_by("rid", F.struct(-F.coalesce("doc_id", F.lit(-(1 << 62))), "rid")).alias("head"))
    # one window over a row for each partition; after the last range comes the first row of all
    ends = first.select("part", F.coalesce(F.lead("head").over(W.orderBy("part")), F.first("head").over(W.orderBy("part"))).alias("after"))
    following = F.coalesce(F.lead("rid").over(order), F.col("after"))
    return ordered.join(work.write(ends, "ends"), "part").select(following.alias("rid"), F.col("rid").alias("receiver"), F.floor(F.col("n_chars") / 3).cast("int").alias("m"))


def compare(docs: DataFrame, work: Workspace) -> DataFrame:
    """Fingerprints of each document's text and edited text, and their likeness to each other and to the next document's.

    Null texts count as empty. Documents go by descending doc_id, null ones last; equal doc_ids by a digest of their
    rows. Rows with equal doc_id and text are one document there, and each of them is returned. A lone document is its
    own next. Columns but doc_id and text are not read. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("rid", F.unhex(F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"), 256)))
    given = work.write(neighbours(keyed.select("rid", "doc_id", F.length("text").alias("n_chars")).distinct(), work), "given")
    base = keyed.select("rid", "doc_id", "text", wide(F.col("text")).alias("lanes"), counts(F.col("text")).alias("found"))
    heads = base.join(given, "rid").select(
        F.col("receiver").alias("rid"), F.col("m"), F.left("text", F.col("m")).alias("head"), F.col("doc_id").alias("next_id"), F.col("lanes").alias("next_lanes"), F.col("found").alias("next_found")
    )
    both = base.join(heads.dropDuplicates(["rid"]), "rid")
    edited = both.withColumn("edited", F.concat(F.left("text", F.length("text") - F.col("m")), "head"))
    made = edited.withColumn("edited_lanes", wide(F.col("edited"))).withColumn("edited_found", counts(F.col("edited")))
    c = F.col
    return made.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(c("lanes"), c("found")).alias("fingerprint"),
        fingerprint(c("edited_lanes"), c("edited_found")).alias("edited_fingerprint"),
        likeness(c("lanes"), c("found"), c("edited_lanes"), c("edited_found")).alias("near_edited"),
        likeness(c("lanes"), c("found"), c("next_lanes"), c("next_found")).alias("near_next"),
        "next_id",
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents").select("doc_id", "text"), Workspace(spark, "fingerprints"))
