"""A Spark data source for numpy archives: reads members by ranges of elements, writes a table as archives.

    spark.dataSource.register(Arrays)
    spark.read.format("fitloom_arrays").option("keys", '{"x": "u"}').option("rows", 1_000_000).load(path)
    df.write.format("fitloom_arrays").mode("append").save(folder)

The directory of an archive and the headers of its arrays are read on the driver; each task then opens the file where
its range begins, so an archive of any size is neither one cell nor one task. Compressed members have no places to
begin at: they are one task per file, read in parts. Files are opened through pyarrow's file systems.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "fitloom_arrays"
ROWS = 1_000_000
BATCH = 65_536


def opened(path: str) -> tuple:
    """(file system, path in it). Spark writes local files as file:/..."""
    path = unquote(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Member:
    """Where an array lies: first byte of its elements (None if it has to be read from its beginning), kind, number."""

    name: str
    start: int | None
    kind: str
    n: int


def header(f) -> tuple:
    """(shape, Fortran order, kind) of an array whose file begins here."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return read(f)


def members(path: str, names: list) -> list:
    files, at = opened(path)
    out = []
    with files.open_input_file(at) as raw, zipfile.ZipFile(raw) as z:
        for name in names:
            info = z.getinfo(name if name.endswith(".npy") else name + ".npy")
            with z.open(info) as f:
                shape, fortran, kind = header(f)
                size = f.tell()
            if kind.kind not in "biuf":
                raise ValueError(f"{path}: {name} holds {kind}, not numbers")
            raw.seek(info.header_offset + 26)
            name_size, extra = np.frombuffer(raw.read(4), "<u2").tolist()
            whole = info.compress_type != zipfile.ZIP_STORED or (fortran and len(shape) > 1)
            out.append(Member(info.filename, None if whole else info.header_offset + 30 + name_size + extra + size, kind.str, int(np.prod(shape, dtype=np.int64))))
    if len({m.n for m in out}) > 1:
        raise ValueError(f"{path}: arrays of different lengths")
    return out


@dataclass
class Range(InputPartition):
    path: str
    members: list
    begin: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.keys, self.rows = json.loads(options["keys"]), int(options.get("rows", ROWS))
        self.files = json.loads(options["files"]) if "files" in options else [options["path"]]

    def partitions(self) -> list:
        out = []
        for path in self.files:
            found = members(path, list(self.keys.values()))
            n = found[0].n
            step = max(n, 1) if any(m.start is None for m in found) else self.rows
            out += [Range(path, found, at, min(n, at + step)) for at in range(0, n, step)]
        return out

    def read(self, part: Range):
        files, at = opened(part.path)
        schema = pa.schema([pa.field(n, pa.float64()) for n in self.keys] + [pa.field("ord", pa.int64())])
        with files.open_input_file(at) as raw:
            streams = []
            for m in part.members:
                if m.start is None:
                    with zipfile.ZipFile(raw) as z, z.open(m.name) as f:
                        shape, fortran, _ = header(f)
                        if fortran and len(shape) > 1:  # its elements lie in another order: read as a whole
                            streams.append(np.load(io.BytesIO(z.read(m.name)), allow_pickle=False).ravel())
                            continue
                    f = zipfile.ZipFile(files.open_input_file(at)).open(m.name)
                    header(f)
                    streams.append(f)
                else:
                    streams.append(m.start)
            for lo in range(part.begin, part.end, BATCH):
                hi = min(part.end, lo + BATCH)
                cols = []
                for m, s in zip(part.members, streams):
                    kind = np.dtype(m.kind)
                    if isinstance(s, np.ndarray):
                        x = s[lo:hi]
                    elif isinstance(s, int):
                        raw.seek(s + lo * kind.itemsize)
                        x = np.frombuffer(raw.read((hi - lo) * kind.itemsize), kind)
                    else:
                        x = np.frombuffer(s.read((hi - lo) * kind.itemsize), kind)
                    cols.append(pa.array(x.astype(np.float64)))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(lo, hi))], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: list


class Writer(DataSourceArrowWriter):
    """Each task writes archives of at most `rows` rows under names that do not end in .npz; commit gives them theirs."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.rows, self.overwrite = options["path"], int(options.get("rows", ROWS)), overwrite

    def write(self, batches) -> Written:
        files, folder = opened(self.path)
        files.create_dir(folder, recursive=True)
        done, held, n = [], [], 0

        def flush():
            nonlocal held, n
            if n:
                table = pa.Table.from_batches(held)
                name = f"{folder}/part-{uuid.uuid4().hex}"
                with files.open_output_stream(name + ".tmp") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
                    for c in table.column_names:
                        data = np.ascontiguousarray(table.column(c).cast(pa.float64()).fill_null(float("nan")).to_numpy())
                        with z.open(c + ".npy", "w", force_zip64=True) as f:
                            np.lib.format.write_array(f, data, allow_pickle=False)
                done.append(name)
            held, n = [], 0

        for b in batches:
            for at in range(0, b.num_rows, self.rows):
                part = b.slice(at, self.rows)
                if n + part.num_rows > self.rows:
                    flush()
                held.append(part)
                n += part.num_rows
        flush()
        return Written(done)

    def commit(self, messages: list) -> None:
        files, folder = opened(self.path)
        new = [name for m in messages if m is not None for name in m.files]
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if old.path.endswith(".npz"):
                    files.delete_file(old.path)
        for name in new:
            files.move(name + ".tmp", name + ".npz")

    def abort(self, messages: list) -> None:
        files, _ = opened(self.path)
        for name in (name for m in messages if m is not None for name in m.files):
            files.delete_file(name + ".tmp")


class Arrays(DataSource):
    """options: keys (JSON: column -> array), path or files (JSON list), rows (elements of a task or file)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ", ".join(f"`{n}` double" for n in json.loads(self.options["keys"])) + ", ord long"

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def read_arrays(spark: SparkSession, path: str, keys: dict, rows: int = ROWS) -> DataFrame:
    """Columns of `keys` (name -> array) and ord, the element's number in its file, of an archive, a folder or a glob of them.
    Files are listed by Spark, without their contents."""
    spark.dataSource.register(Arrays)
    found = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path").orderBy("path").collect()]  # a row per file
    return spark.read.format(NAME).option("keys", json.dumps(keys)).option("files", json.dumps(found)).option("rows", rows).load()


def write_arrays(df: DataFrame, path: str, rows: int = ROWS, mode: str = "append") -> None:
    """Columns of df, as doubles (nulls as NaN), in archives of at most `rows` rows each."""
    df.sparkSession.dataSource.register(Arrays)
    df.write.format(NAME).option("rows", rows).mode(mode).save(path)
