"""Media columns: content-addressed payloads in tar shards; rows carry digest, offset and length.

A payload is stored as a PNG of 8-bit grey samples, 64 to a row. Shards are plain ustar files, so any tar reader opens
them; a range read of one member needs its shard, offset and length only, and one of its first 33 bytes tells its size.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, filled, slices, table

WIDTH = 64
HEADER_BYTES = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
INDEX = "digest binary, shard string, offset long, length long, media_sha256 binary"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 3) -> bytes:
    """payload: a positive multiple of 64 bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    body = np.zeros((len(rows), WIDTH + 1), np.uint8)
    body[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, of a PNG's first 33 bytes, whose checksum is tested."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not the header of a stored payload")
    return struct.unpack(">IIB", head[16:25])


def from_png(media: bytes) -> bytes:
    """The payload of what to_png made."""
    width, height, _ = png_header(media[:HEADER_BYTES])
    size = struct.unpack(">I", media[33:37])[0]
    rows = np.frombuffer(zlib.decompress(media[41 : 41 + size]), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered row")
    return rows[:, 1:].tobytes()


def padded(data: bytes) -> bytes:
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def payload_column(text: Column) -> Column:
    """The same as padded(), of a text column; null counts as empty."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), (F.greatest(F.lit(WIDTH), F.ceil(n / WIDTH) * WIDTH) - n).cast("int"))))


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:/") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one task's members to tar files of about `target` bytes. A file gets its name when it is whole, and the
    name and the bytes depend on the task's input alone: a task that runs again replaces files by the same ones."""

    def __init__(self, folder: str, part: int, target: int, kind: str = "shard"):
        self.fs, self.base = open_folder(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.part, self.target, self.kind, self.count, self.out = part, target, kind, 0, None

    def add(self, name: str, data: bytes) -> tuple[str, int]:
        """The shard's file name and the place of the first byte."""
        if self.out is None:
            self.name = f"{self.kind}-{self.part:05d}-{self.count:05d}.tar"
            self.temp = f"{self.base}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.at, self.count = self.fs.open_output_stream(self.temp), 0, self.count + 1
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        place = self.at + len(head)
        self.out.write(head + data + bytes(-len(data) % 512))
        self.at = place + len(data) + (-len(data) % 512)
        shard = self.name
        if self.at >= self.target:
            self.close()
        return shard, place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None
            self._publish(f"{self.base}/{self.name}", self.at + 1024)

    def _publish(self, final: str, size: int) -> None:
        """Gives the file its name. A whole file of that name, from another attempt of the task, has the same bytes and stays:
        some stores do not rename onto a file, and another attempt may come first between the test and the rename."""
        whole = lambda: self.fs.get_file_info(final).size == size
        if not whole():
            try:
                self.fs.move(self.temp, final)
                return
            except OSError:
                if not whole():
                    raise
        self.fs.delete_file(self.temp)


def store(docs: DataFrame, work: Workspace, text: str = "text", shard_bytes: int = 64 << 20, waste: float = 0.25) -> tuple[DataFrame, str]:
    """Stores the payloads of docs. Returns the index (INDEX, a written table with one row a digest) and the shards' folder.

    Payloads are written by the tasks that read them, so their bytes never cross a shuffle. A task stores a payload
    once however many of its rows have it; of a payload that several tasks store, the index names the first place.
    Shards of whose bytes more than `waste` are then named by nothing are written anew without them, and deleted. Null
    and empty texts have the payload of 64 zero bytes. An empty table gives an empty index.
    """
    folder = work.next_path("shards")

    def write(batches):
        out, seen = ShardWriter(folder, TaskContext.get().partitionId(), shard_bytes), set()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                rows = []
                for data in filled(part.column("text")).cast(pa.large_binary()).to_pylist():
                    payload = padded(data)
                    digest = hashlib.sha256(payload).digest()
                    if digest not in seen:
                        seen.add(digest)
                        media = to_png(payload)
                        shard, place = out.add(f"{digest.hex()}.png", media)
                        rows.append((digest, shard, place, len(media), hashlib.sha256(media).digest()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows), KINDS)] if rows else [pa.array([], k) for k in KINDS], NAMES)
        out.close()

    placed = work.write(docs.select(F.col(text).alias("text")).mapInArrow(write, INDEX), "placed")
    first = placed.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length", "media_sha256")).alias("at"))
    index = work.write(first.select("digest", "at.*"), "first")
    held = lambda df, name: df.groupBy("shard").agg(F.sum("length").alias(name))
    wasteful = held(placed, "all").join(held(index, "used"), "shard", "left").where(F.coalesce("used", F.lit(0)) < (1 - waste) * F.col("all")).select("shard")
    wasteful = work.write(wasteful, "wasteful")
    if wasteful.isEmpty():
        return index, folder
    old = index.join(wasteful, "shard", "left_semi").repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    moved = _copied(old.select(*NAMES), folder, shard_bytes)
    index = work.write(index.join(wasteful, "shard", "left_anti").select(*NAMES).unionByName(moved), "index")
    fs, base = open_folder(folder)
    for row in wasteful.toLocalIterator():
        fs.delete_file(f"{base}/{row['shard']}")
    return index, folder


def _copied(index: DataFrame, folder: str, shard_bytes: int) -> DataFrame:
    """The index of the same payloads in new shards."""

    def run(batches):
        out = ShardWriter(folder, TaskContext.get().partitionId(), shard_bytes, "packed")
        files, base = open_folder(folder)
        name, shard = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["shard"] != name:
                    if shard is not None:
                        shard.close()
                    name, shard = r["shard"], files.open_input_file(f"{base}/{r['shard']}")
                rows.append((r["digest"], *out.add(f"{r['digest'].hex()}.png", shard.read_at(r["length"], r["offset"])), r["length"], r["media_sha256"]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows), KINDS)] if rows else [pa.array([], k) for k in KINDS], NAMES)
        out.close()

    return index.mapInArrow(run, INDEX)


NAMES = ["digest", "shard", "offset", "length", "media_sha256"]
KINDS = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.binary()]


def _ranged(index: DataFrame, folder: str, of, more: str) -> DataFrame:
    """Adds to each index row what of(bytes read at a place) finds; open shards are kept while their rows follow each other."""
    columns = list(index.columns)
    added = [x.split()[0] for x in more.split(", ")]
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in index.schema)}, {more}"
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches):
        files, base = open_folder(folder)
        name, shard = None, None
        for batch in batches:
            found = []
            for row in batch.select(["shard", "offset", "length"]).to_pylist():
                if row["shard"] != name:
                    if shard is not None:
                        shard.close()
                    name, shard = row["shard"], files.open_input_file(f"{base}/{row['shard']}")
                found.append(of(lambda n, row=row, shard=shard: shard.read_at(n if n is not None else row["length"], row["offset"])))
            new = list(zip(*found)) if found else [[] for _ in added]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(v), kinds[x.split()[1]]) for v, x in zip(new, more.split(", ")))], [*columns, *added])
        if shard is not None:
            shard.close()

    return index.mapInArrow(run, schema)


def fill_metadata(index: DataFrame, folder: str) -> DataFrame:
    """Adds width, height and bits, of range reads of 33 bytes a row."""
    return _ranged(index, folder, lambda read: png_header(bytes(read(HEADER_BYTES))), "width int, height int, bits int")


def describe(payload: bytes) -> str:
    """A payload's features: mean and deviation of its samples, their entropy in bits, and the shares of zeros, ASCII letters and high samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts / counts.sum()
    levels = np.arange(256)
    mean = float(p @ levels)
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    letters = p[65:91].sum() + p[97:123].sum()
    return f"mean={mean:.4f};std={float(np.sqrt(max(0.0, p @ (levels - mean) ** 2))):.4f};entropy={abs(entropy):.4f};zero={p[0]:.4f};letters={letters:.4f};high={p[128:].sum():.4f}"


def read_features(index: DataFrame, folder: str) -> DataFrame:
    """Reads each stored form back whole, decodes it and adds what its bytes show."""

    def of(read):
        media = bytes(read(None))
        payload = from_png(media)
        return len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-64:]), hashlib.sha256(media).digest(), describe(payload)

    return _ranged(index, folder, of, "payload_bytes long, payload_sha256 binary, tail_crc32 long, read_sha256 binary, feature string")


def attach(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """Each row of docs less its text, with digest, unpadded size (n_bytes) and what was found for the digest.

    Columns of docs that are named as one of these are replaced. Rows that repeat stay, each with the same values.
    """
    made = {text, "n_bytes", *found.columns}
    raw = F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long")
    digest = F.unhex(F.sha2(payload_column(F.col(f"`{text}`")), 256))
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in made), raw.alias("n_bytes"), digest.alias("digest"))
    return rows.join(found, "digest")


def hexed(name: str) -> Column:
    return F.lower(F.hex(name))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index, folder = store(docs, Workspace(spark, "media"))
    placed = index.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    found = read_features(fill_metadata(placed, folder), folder)
    return attach(docs, found).select(
        "doc_id", "n_bytes", "payload_bytes", hexed("payload_sha256").alias("payload_sha256"), "tail_crc32", F.col("length").alias("media_bytes"),
        hexed("read_sha256").alias("media_sha256"), "feature", "width", "height", hexed("digest").alias("digest"),
    )
