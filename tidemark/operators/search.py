"""Exact vector search of a query set against all rows, in blocks, and fusion and re-ranking of what it finds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset, fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.files import folder

#: Rows of a block of each side: a task holds one of each and their score matrix.
QUERY_BLOCK, ROW_BLOCK = 512, 8192
#: Scores that are held at once: so many queries of a block are compared with a block of rows, at least one.
SCORES = 1 << 19
BLOCK_BYTES = 64 << 20
RESULT = "query_id long, row_id long, score double"


def _scores(qv: np.ndarray, xv: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        small = qv.shape[0] * xv.shape[0] * qv.shape[1] < 1 << 24
        squares = ((qv[:, None, :] - xv[None, :, :]) ** 2).sum(2) if small else (qv**2).sum(1)[:, None] + (xv**2).sum(1)[None] - 2 * qv @ xv.T
        return np.round(-np.sqrt(np.maximum(squares, 0)), 6) + 0.0
    return np.round(qv @ xv.T, 6) + 0.0


METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {m: partial(_scores, metric=m) for m in ("dot", "l2")}


def register_metric(name: str, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Plugs in a score of all pairs of two matrices' rows, greater for nearer ones."""
    METRICS[name] = score


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def top_k(queries: DataFrame, rows: DataFrame, k: int, metric: str = "cosine", same: str | None = None) -> DataFrame:
    """RESULT with rank: each query's k best rows of all rows, by score rounded to 6 places and then the lesser id.

    queries and rows have id (long) and v (array of numbers); with `same` both have that column and only rows that agree
    in it count, before ranking; a null agrees with nothing. metric: cosine, dot, l2 (the distance, negated) or a registered
    one. A zero vector has a cosine of 0 with everything, so a zero query finds the least ids. The queries are written once,
    by `same` if it is given. Each task goes over its own rows in blocks and reads the queries' blocks that they can match; of a pair of blocks,
    each matrix product has SCORES scores at most and keeps k rows a query. Rows' vectors are not shuffled, and memory is that of two blocks at any size.
    """
    spark = rows.sparkSession
    place = folder(spark, "queries")
    label = F.xxhash64(F.col(same)) if same is not None else F.lit(0).cast("long")
    marked = lambda df: df.select("id", "v", label.alias("label")) if same is None else df.where(F.col(same).isNotNull()).select("id", "v", label.alias("label"))
    asked = marked(queries)
    (asked if same is None else asked.repartitionByRange("label").sortWithinPartitions("label")).write.option("parquet.block.size", 4 << 20).parquet(place)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if metric == "cosine" else m
    score = METRICS["dot" if metric == "cosine" else metric]

    def matched(table: pa.Table):
        """RESULT of a block of rows."""
        data = _opened(place)
        order = np.lexsort((table.column("id").to_numpy(), table.column("label").to_numpy()))
        ids, labels, vectors = table.column("id").to_numpy()[order], table.column("label").to_numpy()[order], unit(_matrix(table.column("v").combine_chunks())[order])
        present = np.unique(labels)
        wanted = dataset.field("label").isin(pa.array(present)) if same is not None else None
        for batch in _batches(data, filter=wanted):
            own = batch.column("label").to_numpy()
            for one in np.unique(own):
                here = slice(np.searchsorted(labels, one), np.searchsorted(labels, one, "right"))
                asking = np.flatnonzero(own == one)
                if here.start == here.stop:
                    continue
                step = max(1, SCORES // (here.stop - here.start))
                for mine in (asking[at : at + step] for at in range(0, len(asking), step)):
                    found = score(unit(_matrix(batch.column("v").take(pa.array(mine)))), vectors[here])
                    # rows go by id within a label, so a stable order gives ties to the lesser id
                    best = np.argsort(-found, axis=1, kind="stable")[:, :k]
                    qi = np.broadcast_to(batch.column("id").to_numpy()[mine][:, None], best.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(qi.ravel()), pa.array(ids[here][best].ravel()), pa.array(np.take_along_axis(found, best, 1).ravel())], ["query_id", "row_id", "score"])

    return _best(marked(rows).mapInArrow(_in_blocks(matched), RESULT), k)


def top_overlap(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """RESULT with rank: each query's k best rows with another id, by the share of the query's words that they have, rounded
    to 6 places, and then the lesser id.

    queries and rows have id (long) and w (array of different words; null counts as empty). A query without words has a
    score of 0 with every row. Goes over the rows as top_k does: a word that most rows have costs a list of places in a block,
    and no pair of rows is shuffled but each task's k best.
    """
    place = folder(rows.sparkSession, "queries")
    words = lambda df: df.select("id", F.filter(F.coalesce("w", F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("w"))
    words(queries).write.option("parquet.block.size", 4 << 20).parquet(place)

    def listed(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All words, and where each row's begin and the last one's end."""
        return column.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)

    def matched(table: pa.Table):
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        flat, bounds = listed(table.column("w").combine_chunks())
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        having = np.repeat(np.arange(len(ids)), np.diff(bounds))[order]
        first = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
        for batch in _batches(_opened(place)):
            asked, (said, ends) = batch.column("id").to_numpy(), listed(batch.column("w"))
            known = pc.fill_null(pc.index_in(said, value_set=coded.dictionary), -1).to_numpy(zero_copy_only=False)
            found = np.zeros((len(asked), len(ids)))
            for i, (start, stop) in enumerate(zip(ends, ends[1:])):
                mine = known[start:stop]
                hits = [having[first[c] : first[c + 1]] for c in mine[mine >= 0]]
                if hits:
                    found[i] = np.bincount(np.concatenate(hits), minlength=len(ids))
            found = np.round(found / np.maximum(np.diff(ends), 1)[:, None], 6)
            found[asked[:, None] == ids[None]] = -1
            best = np.argsort(-found, axis=1, kind="stable")[:, :k]
            scores, qi = np.take_along_axis(found, best, 1), np.broadcast_to(asked[:, None], best.shape)
            other = scores >= 0
            yield pa.RecordBatch.from_arrays([pa.array(qi[other]), pa.array(ids[best][other]), pa.array(scores[other])], ["query_id", "row_id", "score"])

    return _best(words(rows).mapInArrow(_in_blocks(matched), RESULT), k)


def _opened(place: str) -> dataset.Dataset:
    files, base = fs.FileSystem.from_uri(place if "://" in place else "file://" + place.removeprefix("file:"))
    return dataset.dataset(base, filesystem=files, format="parquet")


def _batches(data: dataset.Dataset, **options) -> Iterator[pa.RecordBatch]:
    """Blocks of queries, one after the other: the files' defaults read 16 batches of 4 files ahead, which grows with the queries."""
    for file in data.get_fragments():
        yield from dataset.Scanner.from_fragment(file, schema=data.schema, batch_size=QUERY_BLOCK, batch_readahead=1, fragment_readahead=1, use_threads=False, **options).to_batches()


def _in_blocks(matched: Callable) -> Callable:
    """A task over batches of rows, in blocks of ROW_BLOCK rows or BLOCK_BYTES at most (or one batch, if that has more)."""

    def run(batches):
        held, n, size = [], 0, 0
        for batch in batches:
            if held and size + batch.nbytes > BLOCK_BYTES:
                yield from matched(pa.Table.from_batches(held))
                held, n, size = [], 0, 0
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            while n >= ROW_BLOCK:
                table = pa.Table.from_batches(held)
                yield from matched(table.slice(0, ROW_BLOCK))
                held, n = table.slice(ROW_BLOCK).to_batches(), n - ROW_BLOCK
                size = sum(b.nbytes for b in held)
        if n:
            yield from matched(pa.Table.from_batches(held))

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


# The profile that each mode of a request stands for.
PROFILES = {"latency": "latency", "fast": "latency", "accuracy": "accuracy"}


def routed(mode: str | None, indexes: dict[str, DataFrame], default: str = "fast") -> tuple[DataFrame, list[str]]:
    """The index of a request's mode, and warnings. Modes that are not known, and accuracy without an index, go to latency's."""
    wanted = PROFILES.get(mode or default, "latency")
    if wanted == "accuracy" and "accuracy" not in indexes:
        return indexes["latency"], ["Accuracy index not available, using latency index"]
    return indexes[wanted], []


def search(queries: DataFrame, indexes: dict[str, DataFrame], k: int, mode: str | None = None, enabled: bool = True, **options) -> DataFrame:
    """(query_id, mode, results, warnings, reason): a response for each query, with its k best rows as an array. With search
    switched off there are no results, and the reason says so."""
    kind = "array<struct<rank:bigint,row_id:bigint,score:double>>"
    base = queries.select(F.col("id").alias("query_id"))
    if not enabled:
        return base.select("query_id", F.lit("disabled").alias("mode"), F.array().cast(kind).alias("results"), F.array().cast("array<string>").alias("warnings"), F.lit("flags.disabled").alias("reason"))
    index, warnings = routed(mode, indexes)
    found = top_k(queries, index, k, **options).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "row_id", "score"))).alias("results"))
    results = F.coalesce("results", F.array().cast(kind))
    few = F.when(F.size(results) < k, F.concat(F.lit("Only "), F.size(results).cast("string"), F.lit(f" results found (requested {k})")))
    said = F.filter(F.array(few, *map(F.lit, warnings)), lambda x: x.isNotNull())
    return base.join(found, "query_id", "left").select("query_id", F.lit(mode or "fast").alias("mode"), results.alias("results"), said.alias("warnings"), F.lit(None).cast("string").alias("reason"))


def pair_scores(query: Column, text: Column, load: Callable[[], Callable[[list[tuple[str, str]]], object]], batch: int = 32) -> Column:
    """The scores of pairs by a model: load() gives, once a worker, a function from pairs (query, text) to their scores, which
    is called with `batch` pairs at a time. The pairs of a call that fails, or gives another number of scores, have null."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:
            model = None
        for asked, said in parts:
            pairs, out = list(zip(asked.fillna(""), said.fillna(""))), np.full(len(asked), np.nan)
            for k in range(0, len(pairs), batch):
                try:
                    found = np.asarray(model(pairs[k : k + batch]), float).reshape(-1)
                    if len(found) == len(pairs[k : k + batch]):
                        out[k : k + batch] = found
                except Exception:  # these pairs keep their order
                    continue
            yield pd.Series(out, index=asked.index)

    return F.nanvl(run(query, text), F.lit(None).cast("double"))


def rerank(candidates: DataFrame, load: Callable, k: int, batch: int = 32) -> DataFrame:
    """(query_id, row_id, score, rank): the k best of each query's candidates (query_id, row_id, rank, query, text) by a model's
    score of the pair, ties by the old rank. A query of which a pair has no score keeps its old order, with null scores.
    A query has as many candidates as its search kept, so its window is small."""
    scored = candidates.select("query_id", "row_id", F.col("rank").alias("__old"), pair_scores(F.col("query"), F.col("text"), load, batch).alias("score"))
    failed = F.max(F.col("score").isNull()).over(W.partitionBy("query_id"))
    scored = scored.withColumn("__failed", failed).withColumn("score", F.when(~F.col("__failed"), F.col("score")))
    order = W.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "__old", "row_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "row_id", "score", "rank")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def normalised(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    double = F.transform(v, lambda x: x.cast("double"))
    return F.transform(F.array(double), lambda d: F.transform(F.array(norm(d)), lambda n: F.transform(d, lambda x: x / F.when(n == 0, 1.0).otherwise(n)))[0])[0]


def stub_embedding(text: Column, dim: int, seed: int = 42) -> Column:
    """The bytes of sha256("seed:text"), over and over, as (byte - 127.5) / 255."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), text), 256)
    return F.transform(F.array(digest), lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.conv(F.substring(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") - 127.5) / 255.0))[0]


def md5_embedding(text: Column, dim: int) -> Column:
    """The bytes of md5(text), over and over, as (byte - 128) / 128."""
    return F.transform(F.array(F.md5(text)), lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.conv(F.substring(h, (i % 16) * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128.0) / 128.0))[0]


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Of two rankings (query_id, row_id, score, rank): the k rows of each query with the greatest sum of 1 / (constant + rank)."""
    both = _both(a, b)
    fused = F.round(F.coalesce(1.0 / (constant + F.col("rank_a")), F.lit(0.0)) + F.coalesce(1.0 / (constant + F.col("rank_b")), F.lit(0.0)), 6)
    return _ranked(both.withColumn("fused", fused), k)


def weighted_fusion(a: DataFrame, b: DataFrame, k: int, wa: float, wb: float) -> DataFrame:
    both = _both(a, b)
    # scores have six places, so seven do not round halves
    fused = F.round(wa * F.coalesce("score_a", F.lit(0.0)) + wb * F.coalesce("score_b", F.lit(0.0)), 7)
    return _ranked(both.withColumn("fused", fused), k)


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("query_id", "row_id", F.col("score").alias("score_a"), F.col("rank").alias("rank_a"))
    right = b.select("query_id", "row_id", F.col("score").alias("score_b"), F.col("rank").alias("rank_b"))
    return left.join(right, ["query_id", "row_id"], "full_outer")


def _ranked(df: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("fused"), "row_id")
    return df.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "row_id", "fused", "rank_a", "rank_b", "rank")


def mmr(candidates: DataFrame, k: int, trade: float = 0.7) -> DataFrame:
    """(query_id, row_id, pick): k of each query's candidates (row_id, score, v), one after the other, each with the
    greatest trade * score - (1 - trade) * its greatest cosine to those picked. Ties go to the lesser id. A group is one
    query's candidates, of which there are as many as its search kept."""
    schema = "query_id long, row_id long, pick long"

    def run(table: pa.Table) -> pa.Table:
        ids, scores = table.column("row_id").to_numpy(), table.column("score").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, scores = ids[order], scores[order]
        v = np.array(table.column("v").to_pylist(), dtype=np.float64)[order]
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        near, left, picked = np.full(len(ids), -np.inf), np.ones(len(ids), bool), []
        while len(picked) < min(k, len(ids)):
            value = np.where(left, np.round(trade * scores - (1 - trade) * np.where(np.isfinite(near), near, 0.0), 9), -np.inf)
            best = int(np.argmax(value))
            picked.append(best)
            left[best] = False
            near = np.maximum(near, v @ v[best])
        q = table.column("query_id")[0].as_py()
        return pa.table({"query_id": pa.array([q] * len(picked), pa.int64()), "row_id": pa.array(ids[picked], pa.int64()), "pick": pa.array(range(1, len(picked) + 1), pa.int64())})

    return candidates.select("query_id", "row_id", "score", "v").groupBy("query_id").applyInArrow(run, schema)
