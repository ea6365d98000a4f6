"""Following logs of lines that grow, as a source of Structured Streaming whose offsets are bytes in files.

A batch is what was appended since the last one, up to the last whole line; a line that is not ended yet waits. A file is
known by its first line, so one that is renamed by a rotation goes on where it was, and the new one under its name begins
at its first byte. Offsets are in the query's checkpoint, so a restart neither loses nor repeats lines.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a partition, of a read, and of a first line that tell files apart.
SPLIT, READ, HEAD = 32 << 20, 1 << 20, 4096


def _opened(uri: str):
    from pyarrow import fs

    if "://" not in uri:
        uri = "file:///" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _listed(uri: str, suffix: str) -> dict[str, tuple[str, int]]:
    """{identity: (name, size)} of the files of a folder whose names hold `suffix`; files without a whole line are not there yet."""
    from pyarrow import fs

    place, base = _opened(uri)
    infos = place.get_file_info(fs.FileSelector(base, allow_not_found=True))
    found: dict[str, tuple[str, int]] = {}
    for info in sorted((i for i in infos if i.is_file and suffix in i.base_name and not i.base_name.startswith((".", "_"))), key=lambda i: i.path):
        with place.open_input_file(info.path) as f:
            head = f.read(HEAD)
        if b"\n" not in head and len(head) < HEAD:
            continue
        name = hashlib.sha1(head.split(b"\n", 1)[0]).hexdigest()
        k = sum(x.split("#")[0] == name for x in found)
        found[f"{name}#{k}"] = (info.path, info.size)
    return found


def _whole(place, name: str, start: int, size: int) -> int:
    """The end of the last whole line before `size`, at least `start`."""
    with place.open_input_file(name) as f:
        at = size
        while at > start:
            low = max(start, at - READ)
            f.seek(low)
            k = f.read(at - low).rfind(b"\n")
            if k >= 0:
                return low + k + 1
            at = low
    return start


class Piece(InputPartition):
    def __init__(self, identity: str, begin: int, start: int, stop: int):
        self.identity, self.begin, self.start, self.stop = identity, begin, start, stop


class FollowReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.uri, self.suffix, self.from_end = options["path"], options.get("suffix", ""), options.get("start", "begin") == "end"
        self.split = int(options.get("split", SPLIT))

    def _ends(self) -> dict:
        place, _ = _opened(self.uri)
        return {k: _whole(place, name, 0, size) for k, (name, size) in _listed(self.uri, self.suffix).items()}

    def initialOffset(self) -> dict:
        return self._ends() if self.from_end else {}

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict):
        """Pieces of what is new in each file. A file that has become shorter than it was is read from its beginning."""
        out = []
        for k, stop in end.items():
            begin = start.get(k, 0)
            begin = 0 if begin > stop else begin
            out += [Piece(k, begin, at, min(at + self.split, stop)) for at in range(begin, stop, self.split)]
        return out

    def read(self, piece: Piece):
        """(file, at, line) of the lines that begin in a piece; the last one may end in the next."""
        place, _ = _opened(self.uri)
        found = _listed(self.uri, self.suffix)
        if piece.identity not in found:
            raise OSError(f"a followed file is gone before it was read: {piece.identity}")
        name = found[piece.identity][0]
        with place.open_input_file(name) as f:
            # the line that runs into a piece is the one before's
            at = piece.start if piece.start == piece.begin else piece.start - 1
            f.seek(at)
            held, skip = b"", piece.start != piece.begin
            while at < piece.stop:
                data = f.read(READ)
                if not data:
                    return
                held += data
                *lines, held = held.split(b"\n")
                for line in lines:
                    if skip:
                        skip = False
                    elif at < piece.stop:
                        yield (name.rsplit("/", 1)[-1], at, line.decode("utf-8", "replace"))
                    at += len(line) + 1


class FollowedLines(DataSource):
    """Options: path (a folder), suffix (what names hold), start (begin or end), split (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "followed_lines"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema: T.StructType) -> FollowReader:
        return FollowReader(dict(self.options))


def lines(spark: SparkSession, path: str, suffix: str = ".json", start: str = "begin", **options) -> DataFrame:
    """A streaming DataFrame (file, at, line) of the logs in a folder. With start='end' only what is appended after the query's first start."""
    spark.dataSource.register(FollowedLines)
    return spark.readStream.format("followed_lines").options(path=path, suffix=suffix, start=start, **options).load()


def events(spark: SparkSession, path: str, schema: T.StructType, since: str | None = None, at: str = "ts", **options) -> DataFrame:
    """The lines as rows of a schema; lines that are no JSON go. since: only rows whose time is not before it."""
    rows = lines(spark, path, **options).select(F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.try_parse_json("line").isNotNull().alias("whole"))
    rows = rows.where("whole").select("r.*")
    return rows if since is None else rows.where(F.col(at) >= F.lit(since).cast(schema[at].dataType))


def write_part(df: DataFrame, path: str, name: str) -> None:
    """Rows as one more log file of a folder, each task's as a file of its own: what a writer of logs would append."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("line"))

    def run(batches):
        from pyspark import TaskContext

        place, base = _opened(path)
        place.create_dir(base, recursive=True)
        out, n = None, 0
        for batch in batches:
            for line in batch.column("line").to_pylist():
                if out is None:
                    out = place.open_output_stream(f"{base}/.{name}-{TaskContext.get().partitionId():05d}")
                out.write(line.encode() + b"\n")
                n += 1
        if out is not None:
            out.close()
            place.move(f"{base}/.{name}-{TaskContext.get().partitionId():05d}", f"{base}/{name}-{TaskContext.get().partitionId():05d}.json")
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()


__all__ = ["FollowedLines", "events", "lines", "write_part"]
