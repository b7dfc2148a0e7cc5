"""Shared helpers: table access, scratch tables in the shared folder, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes outside this ASCII white space; bytes.split() splits at the same set.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors; on a local master, which has no others, one of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="fitloom-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove a table made by stage() that no later plan reads."""
    path = getattr(df, "scratch_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


ROW = "_row"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df written once with a number of its own for every row, in the column ROW: rows that share an id, or
    have none, or are equal, stay apart in joins."""
    return stage(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def set_aside(df: DataFrame, name: str, needed: tuple) -> tuple:
    """(rows, view): df written once under names that no column of ours has, with ROW, and its columns `needed` by their
    own names, with ROW. given_back() restores rows."""
    names = [f"u{i}" for i in range(len(df.columns))]
    rows = numbered(df.toDF(*names), name)
    at = dict(zip(df.columns, names))
    return rows, rows.select(ROW, *(F.col(at[c]).alias(c) for c in needed))


def given_back(rows: DataFrame, columns: list) -> DataFrame:
    return rows.select(*(f"u{i}" for i in range(len(columns)))).toDF(*columns)


def sample_by_hash(df: DataFrame, h: Column, most: int) -> DataFrame:
    """About `most` rows (all, if there are no more), those with the least hash: a filter, no sort.

    h: a 64-bit hash. The number varies by chance, so readers that need a strict bound stop at it."""
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.shiftrightunsigned(h, 1) < int((most - 3 * most**0.5) / n * (1 << 63)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
