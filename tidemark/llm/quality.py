"""Quality classifier: gated-attention multiple-instance learning over the passages of a text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import buffers, slices, table, unit_hash

#: Bytes of a passage at most; a passage also ends at each line end.
PASSAGE_BYTES = 600
#: Classes of bytes, and how many buckets their bigrams share.
CLASSES, PAIRS = 40, 88
FEATURES = CLASSES + PAIRS + 4


def _byte_classes() -> np.ndarray:
    """Printable ASCII that is no letter or digit has a class each; letters, digits and other bytes share classes."""
    out = np.full(256, 0, np.int64)
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    out[marks] = np.arange(len(marks)) + 8
    for k, group in enumerate(("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", " \t\r\v\f", "\n"), 1):
        out[[ord(c) for c in group]] = k
    return out


BYTE_CLASS = _byte_classes()
assert BYTE_CLASS.max() < CLASSES


def passage_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all passages, and of which text each is. A text without bytes has one empty passage."""
    starts = [bounds[:-1]]
    ends = np.flatnonzero(data == 10) + 1
    starts.append(ends[ends < len(data)])
    first = np.unique(np.concatenate(starts))
    sizes = np.diff(np.append(first, len(data)))
    long = sizes > PASSAGE_BYTES
    more = -(-sizes[long] // PASSAGE_BYTES) - 1
    inner = np.repeat(first[long], more) + PASSAGE_BYTES * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    cut = np.sort(np.concatenate([first[first < len(data)], inner]))
    owner = np.searchsorted(bounds, cut, "right") - 1
    empty = np.flatnonzero(np.diff(bounds) == 0)
    cut, owner = np.concatenate([cut, bounds[empty]]), np.concatenate([owner, empty])
    order = np.argsort(owner, kind="stable")
    return cut[order], owner[order]


def encode(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each passage, and of which text it is: log rates of byte classes and class pairs, size and word shape."""
    cut, owner = passage_bounds(data, bounds)
    n = len(cut)
    stops = np.minimum(np.append(cut[1:], len(data)), bounds[owner + 1])
    sizes = stops - cut
    of = np.repeat(np.arange(n), sizes)
    kinds = BYTE_CLASS[data]
    one = np.bincount(of * CLASSES + kinds, minlength=n * CLASSES).reshape(n, CLASSES)
    same = of[1:] == of[:-1]
    pair = (kinds[:-1] * 53 + kinds[1:]) % PAIRS
    two = np.bincount((of[1:] * PAIRS + pair)[same], minlength=n * PAIRS).reshape(n, PAIRS)
    total = np.maximum(sizes, 1)[:, None]
    letters, space = one[:, 1:5].sum(1), one[:, 6]
    rest = np.stack([np.log1p(sizes), letters / total[:, 0], one[:, 3:5].sum(1) / np.maximum(letters, 1), sizes / (space + 1.0) / 10], 1)
    return np.concatenate([np.log1p(200 * one / total), np.log1p(200 * two / total), rest], 1).astype(np.float32), owner


@dataclass
class AttentionMil:
    """score = sigmoid(c . sum_i a_i h_i + d); h = tanh(x W + b); a = softmax over a text's passages of w . (tanh(h V) * sigmoid(h U))."""

    hidden: int = 24
    gate: int = 12
    epochs: int = 60
    batch: int = 128
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7

    def fit(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> AttentionMil:
        """x: passages in the order of their texts; owner: text of each; y: label of each text. Adam on class-balanced log loss."""
        rng = np.random.default_rng(self.seed)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        x = self._scaled(x)
        shape = {"W": (x.shape[1], self.hidden), "b": (self.hidden,), "V": (self.hidden, self.gate), "U": (self.hidden, self.gate), "w": (self.gate,), "c": (self.hidden,), "d": ()}
        p = {k: rng.normal(0, 1 / np.sqrt(max(1, s[0] if s else 1)), s) if k in "WVUwc" else np.zeros(s) for k, s in shape.items()}
        first = np.searchsorted(owner, np.arange(len(y) + 1))
        balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
        for _ in range(self.epochs):
            order = rng.permutation(len(y))
            for chosen in np.array_split(order, max(1, len(y) // self.batch)):
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in chosen])
                bag = np.repeat(np.arange(len(chosen)), np.diff(first)[chosen])
                grads = self._gradients(p, x[rows], bag, y[chosen], balance[chosen])
                t += 1
                for k in p:
                    g = grads[k] + self.decay * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - self.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p = p
        return self

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -6, 6)

    @staticmethod
    def _forward(p: dict, x: np.ndarray, bag: np.ndarray, n: int) -> dict:
        h = np.tanh(x @ p["W"] + p["b"])
        gt, gs = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (gt * gs) @ p["w"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, bag, e)
        a = np.exp(e - top[bag])
        a /= np.bincount(bag, a, n)[bag]
        z = np.stack([np.bincount(bag, a * h[:, k], n) for k in range(h.shape[1])], 1)
        return {"h": h, "gt": gt, "gs": gs, "a": a, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def _gradients(self, p: dict, x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        f = self._forward(p, x, bag, len(y))
        h, gt, gs, a, z = (f[k] for k in ("h", "gt", "gs", "a", "z"))
        do = weight * (f["score"] - y) / len(y)
        dz = do[:, None] * p["c"]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.bincount(bag, a * da, len(y))[bag])
        dgt, dgs = de[:, None] * p["w"] * gs * (1 - gt * gt), de[:, None] * p["w"] * gt * gs * (1 - gs)
        dh = (a[:, None] * dz[bag] + dgt @ p["V"].T + dgs @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dgt, "U": h.T @ dgs, "w": (gt * gs).T @ de, "c": z.T @ do, "d": do.sum()}

    def score(self, x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return self._forward(self.p, self._scaled(x), owner, n)["score"]


@dataclass
class Constant:
    """What is learnt from no labels, or from those of one class."""

    value: float

    def score(self, x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return np.full(n, self.value)


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, passages): each text's vectors, one after the other, as float32 bytes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = buffers(part.column("text"))
                x, owner = encode(data, bounds)
                first = np.searchsorted(owner, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([x[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], ["key", "passages"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, passages binary").withColumnRenamed("key", key)


def most_passages(text: Column) -> Column:
    """How many passages a text has at most: its lines, and the cuts inside them."""
    raw = F.coalesce(text, F.lit(""))
    lines = F.length(raw) - F.length(F.replace(raw, F.lit("\n"))) + 1
    return lines.cast("long") + F.floor(F.octet_length(raw) / PASSAGE_BYTES)


def train(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", per_class: int = 1500, passages: int = 200_000, model: AttentionMil | None = None, seed: int = 11) -> AttentionMil | Constant:
    """Fits the model on a bounded sample of labelled rows, each with all passages of its text.

    per_class: rows of each label (0 and 1) at most, those of the least keyed hash; passages: of the whole sample at most.
    Rows are taken in the order of the hash while their passages together stay within it; a row with more than a fiftieth
    of it alone is passed over, lest it takes the place of many. So what is sent to every executor (the chosen keys) and to
    the driver (their passages) is small at any size and length of the input. Scoring has no such bound.

    Labels that are null or neither 0 nor 1, and labels of no document, teach nothing; of labels of one key that differ,
    the least counts, and of its texts the least. With labels of one class only the result is that class, with none 0.5.
    """
    clean = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).cast("int").alias("y"))
    place = unit_hash(F.col(key), seed=seed)
    chosen = None
    for y in (0, 1):
        part = clean.where(F.col("y") == y).orderBy(place, key).limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(chosen), key).groupBy(key).agg(F.min("text").alias("text"), F.min("y").alias("y"))
    # one window over at most 2 * per_class rows
    costs = rows.select(key, "y", most_passages(F.col("text")).alias("cost")).where(F.col("cost") <= max(1, passages // 50))
    taken = costs.withColumn("sum", F.sum("cost").over(W.orderBy(place, key))).where(F.col("sum") <= passages).select(key, "y")
    found = encoded(rows.select(key, "text"), key, "text").join(F.broadcast(taken), key).orderBy(key).collect()
    y = np.array([r["y"] for r in found], float)
    if not len(y) or y.min() == y.max():
        return Constant(float(y[0]) if len(y) else 0.5)
    vectors = [np.frombuffer(r["passages"], np.float32).reshape(-1, FEATURES) for r in found]
    owner = np.repeat(np.arange(len(y)), [len(v) for v in vectors])
    return (model or AttentionMil()).fit(np.concatenate(vectors), owner, y)


def score(docs: DataFrame, model: AttentionMil | Constant, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of docs and `out`, from 0 to 1. Null and empty texts count as one empty passage; a column that is
    named as `out` is replaced. Each row is scored from its whole text alone, so equal texts have equal scores."""
    rest = [c for c in docs.columns if c != out]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                data, bounds = buffers(part.column(text))
                x, owner = encode(data, bounds)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(x, owner, part.num_rows), pa.float64())], [*rest, out])

    chosen = docs.select(*(F.col(f"`{c}`") for c in rest))
    return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields, T.StructField(out, T.DoubleType())]))


def held_out(key: str = "doc_id"):
    """Rows whose labels are for testing: crc32 of the key as text leaves 1 when divided by 3. A null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> AttentionMil | Constant:
    return train(docs, table(spark, sf_dir, "labels").where(~held_out()), "quality")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, trained(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
