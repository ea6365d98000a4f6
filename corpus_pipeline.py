"""Corpus pipeline: quality, line dedup, near duplicates, mixing, pieces. Each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import lines, mixing, neardup, pieces, quality
from tidemark.llm.common import Workspace, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more. The model is learnt from the table's own documents, whatever `docs` still has."""
    model = quality.trained(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    return quality.score(docs, model, out="__score").where("__score >= 0.5").drop("__score")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the runs of two or more lines that an earlier place has; n_chars is counted again. A text of which all goes stays, empty."""
    cut = lines.deduplicated_lines(docs, Workspace(spark, "lines")).drop("lines_removed", "bytes_removed")
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates on five words, the document with the least doc_id."""
    return neardup.deduplicated(docs, Workspace(spark, "neardup"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate asks for."""
    return mixing.resampled(docs, mixing.label_domains(table(spark, sf_dir, "labels")), Workspace(spark, "mixing"))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, the text's pieces and whether they decode to it."""
    return pieces.encoded(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding", piece_stage),
]

#: Most stages are learnt models or seeded encoders, which SQL cannot express; tests/llm compares each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written in the shared folder and read again. What a stage has written
    besides, and what it read, goes once its result is there; the last stage reads the one table that stays."""
    work, docs, before = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = work.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            work.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
