"""Readers and writers of JSON, YAML and versioned datasets over Spark's sources."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Paths made inside scratch(), while it is open.
_made: ContextVar[list | None] = ContextVar("made", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Folders that are made inside, by whatever operator, are removed at the end: what reads them must be written elsewhere by then."""
    found: list[str] = []
    token = _made.set(found)
    try:
        yield
    finally:
        _made.reset(token)
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, found):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or in local mode one that is made here."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='shared-')}")
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (found := _made.get()) is not None:
        found.append(path)
    return path


def write_jsonl(df: DataFrame, spark: SparkSession, name: str) -> str:
    path = folder(spark, name)
    df.write.json(path)
    return path


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, corrupt: str | None = None) -> DataFrame:
    """Lines of JSON by a given schema; blank lines are skipped, and lines that do not parse go, or with `corrupt` stay with their text in that column."""
    if corrupt is None:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).json(path)


def find_files(spark: SparkSession, path: str, pattern: str | tuple[str, ...] = "*", recursive: bool = True, after: str | None = None) -> DataFrame:
    """(path, length, modificationTime) of the files below a path by name, each once and without their content; with `after`
    those changed later than that time. A path that is missing has none. Several patterns are alternatives."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.range(0).select(F.lit("").alias("path"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"))
    glob = pattern if isinstance(pattern, str) else f"{{{','.join(pattern)}}}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "modificationTime").distinct()
    return (files if after is None else files.where(F.col("modificationTime") > F.lit(after).cast("timestamp"))).orderBy("path")


def append_daily(df: DataFrame, path: str, at: str) -> None:
    """Adds rows to a log of JSON lines with a folder for each day of `at`; earlier rows stay."""
    df.withColumn("date", F.date_format(at, "yyyy-MM-dd")).write.mode("append").partitionBy("date").json(path)


def read_daily(spark: SparkSession, path: str, schema: T.StructType, day: str | None = None) -> DataFrame:
    """The rows of a daily log, or of one day, of which only that folder is read."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("date", T.StringType())])).json(path)
    return (rows if day is None else rows.where(F.col("date") == day)).select(*schema.names)


def write_records(records: DataFrame, summary: DataFrame, path: str, lane: str) -> tuple[str, str]:
    """The records of an evaluation run of a lane as JSON lines, and its summary of one row."""
    places = f"{path}/records_{lane}", f"{path}/summary_{lane}"
    records.write.mode("overwrite").json(places[0])
    summary.coalesce(1).write.mode("overwrite").json(places[1])
    return places


def write_by_document(chunks: DataFrame, path: str, key: str, order: str) -> None:
    """Chunks as JSON lines with one file for each document, in a folder named by it."""
    chunks.repartition(key).sortWithinPartitions(key, order).write.mode("overwrite").partitionBy(key).json(path)


def copy_files(manifest: DataFrame, target: str) -> DataFrame:
    """(id, copied, error): the files of a manifest (id, path) copied to target/<id>. One that is missing or fails is skipped
    and says why. A task that runs again writes the same files. Run it by an action, and once."""
    import pyarrow as pa
    from pyarrow import fs

    def run(batches):
        def opened(uri: str):
            if "://" not in uri:
                uri = "file:///" + uri.removeprefix("file:").lstrip("/")
            return fs.FileSystem.from_uri(uri)

        place, base = opened(target)
        place.create_dir(base, recursive=True)
        for batch in batches:
            rows = []
            for ident, path in zip(batch.column("id").to_pylist(), batch.column("path").to_pylist()):
                try:
                    source, name = opened(path)
                    with source.open_input_stream(name) as given, place.open_output_stream(f"{base}/{ident}") as out:
                        while data := given.read(1 << 20):
                            out.write(data)
                    rows.append((ident, True, None))
                except (OSError, AttributeError, TypeError, pa.ArrowInvalid) as e:
                    rows.append((ident, False, type(e).__name__))
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.bool_(), pa.string()))], ["id", "copied", "error"])

    return manifest.select(F.col("id").cast("string").alias("id"), "path").mapInArrow(run, "id string, copied boolean, error string")


def write_matrix(df: DataFrame, path: str, row: str, vector: str, dim: int) -> int:
    """Vectors by their row numbers (0, 1, ..) as float32; returns how many. Tasks have ranges of rows and write them where they belong.

    On a file system with positioned writes (file://) that is one .npy file, whose header and size are there first; in other
    stores it is path.parts/<first row>, without headers, and a manifest. A task that runs again writes the same bytes.
    """
    import json

    import numpy as np
    import pyarrow as pa
    from pyarrow import fs

    place, name = fs.FileSystem.from_uri(path)
    found = df.agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("low"), F.max(row).alias("high"), F.count_if(F.col(vector).isNull() | (F.size(vector) != dim)).alias("odd")).first()
    n = found["n"]
    if n and (found["low"] != 0 or found["high"] != n - 1 or found["odd"]):
        raise ValueError(f"{n} rows from {found['low']} to {found['high']}, {found['odd']} of them without {dim} dimensions")
    header, whole = _npy_header(n, dim), isinstance(place, fs.LocalFileSystem)
    place.create_dir(name.rsplit("/", 1)[0] if whole else f"{name}.parts", recursive=True)
    if whole:
        with open(name, "wb") as f:
            f.write(header)
            f.truncate(len(header) + n * dim * 4)

    def run(batches):
        out, first, at = None, None, None
        for batch in batches:
            ids = batch.column("row").to_numpy()
            if not len(ids):
                continue
            if (np.diff(ids) != 1).any() or at not in (None, ids[0]):
                raise ValueError("row numbers that repeat or lack")
            if out is None:
                first = int(ids[0])
                out = open(name, "r+b") if whole else place.open_output_stream(f"{name}.parts/{first:015d}")
                if whole:
                    out.seek(len(header) + first * dim * 4)
            out.write(batch.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())
            at = int(ids[-1]) + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([at - first], pa.int64())], ["first", "rows"])

    dealt = df.select(F.col(row).cast("long").alias("row"), F.col(vector).cast("array<float>").alias("v")).repartitionByRange("row").sortWithinPartitions("row")
    parts = [tuple(r) for r in dealt.mapInArrow(run, "first long, rows long").collect()]  # a row a task
    if sum(k for _, k in parts) != n:
        raise ValueError("not all rows were written")
    if not whole:
        with place.open_output_stream(f"{name}.parts/manifest.json") as out:
            out.write(json.dumps({"rows": n, "dim": dim, "parts": sorted(parts)}).encode())
    return n


def _npy_header(n: int, dim: int) -> bytes:
    import io

    import numpy as np

    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (n, dim)})
    return out.getvalue()


def _matrix_layout(path: str) -> tuple[list[tuple[int, int, str, int]], int, str]:
    """(first row, rows, file, byte of the first row) of a matrix's files, its columns and the kind of its numbers."""
    import json

    import numpy as np
    from pyarrow import fs

    place, name = fs.FileSystem.from_uri(path)
    if place.get_file_info(f"{name}.parts/manifest.json").is_file:
        with place.open_input_stream(f"{name}.parts/manifest.json") as f:
            said = json.loads(f.read())
        return [(first, rows, f"{name}.parts/{first:015d}", 0) for first, rows in said["parts"]], said["dim"], "<f4"
    with place.open_input_file(name) as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
        begin = f.tell()
    if fortran or len(shape) != 2:
        raise ValueError("not a matrix by rows")
    return [(0, shape[0], name, begin)], shape[1], kind.str


def read_matrix(spark: SparkSession, path: str, parts: int = 8) -> DataFrame:
    """(row, v) of a .npy file of numbers or of the parts that write_matrix makes; each task reads its rows only."""
    import numpy as np
    import pyarrow as pa
    from pyarrow import fs

    layout, dim, kind = _matrix_layout(path)

    def run(batches):
        source, _ = fs.FileSystem.from_uri(path)
        width, dtype = dim * np.dtype(kind).itemsize, np.dtype(kind)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for first, rows, file, begin in layout:
                low, high = max(int(ids[0]), first) if len(ids) else 0, min(int(ids[-1]) + 1, first + rows) if len(ids) else 0
                if low < high:
                    with source.open_input_file(file) as f:
                        data = np.frombuffer(f.read_at((high - low) * width, begin + (low - first) * width), dtype).astype(np.float32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1) * dim, pa.int32()), pa.array(data))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, high), pa.int64()), lists], ["row", "v"])

    return spark.range(0, sum(rows for _, rows, _, _ in layout), numPartitions=parts).mapInArrow(run, "row long, v array<float>")


def aligned(vectors: DataFrame, metadata: DataFrame, row: str = "row") -> DataFrame:
    """Vectors and metadata by their row numbers. Raises ValueError if there are not as many of one as of the other."""
    n, m = vectors.count(), metadata.count()
    if n != m:
        raise ValueError(f"{n} vectors but {m} rows of metadata")
    return vectors.join(metadata, row)


def load_index(spark: SparkSession, path: str, metadata: T.StructType) -> DataFrame:
    """(row, v, metadata..) of an index folder in one of three layouts: a parquet dataset; vectors.npy beside metadata as
    parquet; or vectors.npy beside meta.jsonl. Rows of meta.jsonl without a row number are left out."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    has = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(root, name))
    whole = T.StructType([T.StructField("row", T.LongType()), *metadata.fields])
    if not has("vectors.npy"):
        return spark.read.schema(T.StructType([T.StructField("row", T.LongType()), T.StructField("v", T.ArrayType(T.FloatType())), *metadata.fields])).parquet(path)
    rows = spark.read.schema(whole).parquet(f"{path}/metadata.parquet") if has("metadata.parquet") else spark.read.schema(whole).json(f"{path}/meta.jsonl").where("row IS NOT NULL")
    return aligned(read_matrix(spark, f"{path}/vectors.npy"), rows)


def read_yaml(spark: SparkSession, text: str, schema: T.StructType) -> DataFrame:
    """A small YAML list (a registry, prompts) as rows."""
    import yaml

    rows = yaml.safe_load(text) or []
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def versioned(spark: SparkSession, df: DataFrame, name: str, by: str) -> DataFrame:
    """Writes a new version, partitioned, and reads it: readers of an older version keep their files."""
    path = folder(spark, name)
    df.write.partitionBy(by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def split_objects(df: DataFrame, column: str) -> DataFrame:
    """The columns of df but one, with part (from 1) and object for each JSON object of that column."""
    rest = [c for c in df.columns if c != column]

    def cut(raw: str) -> list[str]:
        found, depth, quoted, skip, start = [], 0, False, False, 0
        for i, c in enumerate(raw):
            if skip:
                skip = False
            elif quoted:
                quoted, skip = c != '"', c == "\\"
            elif c == '"':
                quoted = True
            elif c == "{":
                start = i if depth == 0 else start
                depth += 1
            elif c == "}" and depth:
                depth -= 1
                if depth == 0:
                    found.append(raw[start : i + 1])
        return found

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def parts(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else cut(x))

    return df.select(*rest, F.posexplode(parts(column)).alias("part", "object")).withColumn("part", F.col("part") + 1)
