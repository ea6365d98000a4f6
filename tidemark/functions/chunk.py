"""Chunking as Column functions: fixed word windows and greedy packing of sentences with overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import sentences, words


def fixed_windows(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """array of struct(start, stop, text): windows of `size` words, each `overlap` words into the one before; the last ends with the text."""
    step = size - overlap

    def cut(w):
        n = F.size(w)
        last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step) * step).cast("int")
        starts = F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda a: F.struct(a.cast("long").alias("start"), F.least(a + size, n).cast("long").alias("stop"), F.array_join(F.slice(w, a + 1, F.lit(size)), " ").alias("text")))

    return F.flatten(F.transform(F.array(words(text)), cut))


def greedy_chunks(text: Column, most: int, overlap: int) -> Column:
    """array of array of sentences. Sentences are packed while their token estimates stay within `most`; a chunk then
    begins with the trailing sentences of the one before that have at most `overlap` tokens together. A sentence of
    more than `most` tokens is a chunk of its own, or ends one."""
    size = lambda s: F.floor(F.length(s) / 4)
    empty = F.array().cast("array<string>")

    def tail(chunk):
        begin = F.struct(empty.alias("kept"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("over"))

        def step(acc, s):
            fits = ~acc["over"] & (acc["n"] + size(s) <= overlap)
            return F.struct(F.when(fits, F.concat(F.array(s), acc["kept"])).otherwise(acc["kept"]).alias("kept"), F.when(fits, acc["n"] + size(s)).otherwise(acc["n"]).alias("n"), (acc["over"] | ~fits).alias("over"))

        return F.aggregate(F.reverse(chunk), begin, step, lambda a: a["kept"])

    total = lambda chunk: F.aggregate(chunk, F.lit(0).cast("long"), lambda a, s: a + size(s))
    begin = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("open"), F.lit(0).cast("long").alias("n"))

    def pack(acc, s):
        full = (F.size(acc["open"]) > 0) & (acc["n"] + size(s) > most)

        def after(kept):
            return F.struct(
                F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
                F.concat(kept, F.array(s)).alias("open"),
                (F.when(full, total(kept)).otherwise(acc["n"]) + size(s)).alias("n"),
            )

        return F.transform(F.array(F.when(full, tail(acc["open"])).otherwise(acc["open"])), after)[0]

    return F.aggregate(sentences(text), begin, pack, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))
