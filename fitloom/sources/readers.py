"""Point tables from files and strings. Text formats are parsed by Spark; numpy archives by ranges of their elements."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrays

MISSING = ("", "NA", "null", "NaN", "nan")
EXTENSIONS = {"csv": "csv", "txt": "ascii", "dat": "ascii", "asc": "ascii", "tsv": "ascii", "npz": "npz", "h5": "hdf5", "hdf5": "hdf5", "parquet": "parquet"}


def detect(path: str) -> str:
    kind = EXTENSIONS.get(path.rstrip("/").rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ValueError(f"unknown format: {path}")
    return kind


def number(c):
    """A string column as a double; missing marks and what is no number become null."""
    return F.when(F.trim(c).isin(*MISSING), F.lit(None)).otherwise(F.trim(c).try_cast("double"))


def numbered_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """value, file, at and ord of every line: `at` rises along each file, `ord` by file, then along it.

    A line's `at` is where its split begins plus its number in the split, so it rises from split to split
    whatever the order in which Spark reads splits and files. Files are numbered from a row per split.
    """
    lines = spark.read.option("encoding", encoding).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("file", "_b").agg(F.min("_id").alias("_first"))
    splits = splits.withColumn("_f", F.dense_rank().over(W.orderBy("file")).cast("long"))
    at = F.col("_b") + F.col("_id") - F.col("_first")
    return lines.join(splits, ["file", "_b"]).select("value", "file", at.alias("at"), (F.shiftleft(F.col("_f"), 42) + at).alias("ord"))


def without_edges(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Lines but for the first and the last so many of every file: the edges are found by a limited rank per file."""
    for n, order, inner in ((first, F.col("at"), F.max), (last, F.desc("at"), F.min)):
        if n:
            rank = F.row_number().over(W.partitionBy("file").orderBy(order))
            edge = lines.select("file", "at").withColumn("_r", rank).filter(F.col("_r") <= n).groupBy("file").agg(inner("at").alias("_edge"))
            beyond = F.col("at") > F.col("_edge") if inner is F.max else F.col("at") < F.col("_edge")
            lines = lines.join(edge, "file").filter(beyond).drop("_edge")
    return lines


def ascii_table(spark: SparkSession, path: str, columns: dict, delimiter: str | None = None, comment: str = "#", skip_header: int = 0, skip_footer: int = 0) -> DataFrame:
    """Whitespace or delimited text. columns: name -> 0-based position. Lines keep their order in `ord`; headers
    and footers are skipped in every file."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    if comment:
        lines = lines.withColumn("value", F.split("value", "\\Q" + comment + "\\E")[0]).filter(F.trim("value") != "")
    lines = without_edges(lines, skip_header, skip_footer)
    parts = F.split(F.trim("value"), "\\Q" + delimiter + "\\E" if delimiter else "\\s+")
    return lines.select(*(number(F.get(parts, F.lit(i))).alias(n) for n, i in columns.items()), "ord")


def csv_table(spark: SparkSession, path: str, columns: dict, header: bool = True, delimiter: str = ",", comment: str = "#", encoding: str = "UTF-8", skip_header: int = 0) -> DataFrame:
    """columns: name -> header name or 0-based position. Missing marks become null. skip_header: lines of every
    file before its header (or first row); cells may then hold no line breaks."""
    options = {"sep": delimiter, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    if skip_header:
        lines = without_edges(numbered_lines(spark, path, encoding), skip_header, 0).filter(F.trim("value") != "")
        if comment:
            lines = lines.filter(~F.trim("value").startswith(comment))
        head = lines.orderBy("ord").limit(1).collect()  # one line
        cells = head[0].value if head else ""
        width = len(spark.range(1).select(F.schema_of_csv(F.lit(cells or "a"), options).alias("s")).first().s.split(","))
        schema = ", ".join(f"_c{i} string" for i in range(width))
        parse = lambda c: F.from_csv(c, schema, options)
        names = [f"_c{i}" for i in range(width)]
        if header:
            titles = list(spark.createDataFrame([(cells,)], "v string").select(parse(F.col("v")).alias("s")).first().s)
            lines = without_edges(lines, 1, 0)
            columns = {n: titles.index(c) if isinstance(c, str) else c for n, c in columns.items()}
        raw = lines.select(parse(F.col("value")).alias("s"), "ord").select("s.*", "ord")
    else:
        raw = spark.read.csv(path, header=header, comment=comment, encoding=encoding, inferSchema=False, **options)
        names = raw.columns
        raw = raw.withColumn("ord", F.monotonically_increasing_id())
    return raw.select(*(number(F.col(f"`{names[c] if isinstance(c, int) else c}`")).alias(n) for n, c in columns.items()), "ord")


def npz_table(spark: SparkSession, path: str, keys: dict, rows: int = arrays.ROWS) -> DataFrame:
    """Arrays of numpy archives, one row per element; keys: name -> array in the archive. A task reads `rows` elements."""
    return arrays.read_arrays(spark, path, keys, rows)


def hdf5_table(spark: SparkSession, path: str, keys: dict) -> DataFrame:
    """Datasets of HDF5 files, where h5py is installed."""
    try:
        import h5py  # noqa: F401
    except ImportError as e:
        raise ImportError("reading HDF5 needs h5py") from e
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(it):
        import h5py

        for pdf in it:
            for content in pdf["content"]:
                with h5py.File(io.BytesIO(content)) as f:
                    cols = {n: np.ravel(f[k][()]).astype(float) for n, k in keys.items()}
                yield pd.DataFrame(cols).assign(ord=np.arange(len(next(iter(cols.values())))))

    return files.mapInPandas(run, ", ".join(f"`{n}` double" for n in keys) + ", ord long")


def sniff_delimiter(text: str) -> str | None:
    """Tab, comma or None (white space) by the first five lines; a tab wins ties."""
    lines = [x for x in text.splitlines() if x.strip()][:5]
    tabs, commas = (sum(x.count(c) for x in lines) for c in "\t,")
    return "\t" if tabs and tabs >= commas else "," if commas else None


def pasted(spark: SparkSession, text: str, names: tuple = ("x", "y", "sigma")) -> DataFrame:
    """Numbers pasted as text; a first line that holds no number is a header."""
    d = sniff_delimiter(text)
    rows = []
    for line in text.splitlines():
        cells = [c.strip() for c in (line.split(d) if d else line.split())]
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        try:
            rows.append(tuple(None if c in MISSING else float(c) for c in cells))
        except ValueError:
            if rows:
                raise
    width = max(map(len, rows), default=0)
    names = [*names, *(f"c{i}" for i in range(width))][:width]
    return spark.createDataFrame([r + (None,) * (width - len(r)) + (i,) for i, r in enumerate(rows)], ", ".join(f"`{n}` double" for n in names) + ", ord long")


def load(spark: SparkSession, path: str, columns: dict, format: str | None = None, **options) -> DataFrame:
    """By format or extension: ascii, csv, npz, hdf5 or parquet."""
    kind = format or detect(path)
    match kind:
        case "ascii":
            return ascii_table(spark, path, columns, **options)
        case "csv":
            return csv_table(spark, path, columns, **options)
        case "npz":
            return npz_table(spark, path, columns, **options)
        case "hdf5":
            return hdf5_table(spark, path, columns)
        case "parquet":
            return spark.read.parquet(path).select(*(F.col(c).cast("double").alias(n) for n, c in columns.items()))
    raise ValueError(f"unknown format: {kind}")
