"""What is kept in the folder that the driver and all executors share: tables, so that they are computed once and survive
lost executors, and logs of evaluations, so that fits survive a lost driver."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master, which has no other machines, may do with a folder of this one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fitloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_WRITTEN: list = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back. It stays, since later plans read it, until clear()."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Remove every table that written() made in this process; frames that read them can no longer be used."""
    for path in _WRITTEN:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    n = len(_WRITTEN)
    _WRITTEN.clear()
    return n


class Log:
    """The evaluations of a fit, in the order they were made, as files in a shared folder: what a solver asked and what it
    was answered. A fit that was stopped anywhere and is started again with its log is answered from it as far as it
    goes, without a job, and takes the same path from there; so every solver can be resumed, whatever it holds.

    A file is moved to its place when it is whole. A log of another fit raises ValueError.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop, self.path, self.at = spark._jvm.org.apache.hadoop.fs, path.rstrip("/"), 0
        self.files = self.hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.mkdirs(self.hadoop.Path(self.path))
        done = {s.getPath().getName() for s in self.files.listStatus(self.hadoop.Path(self.path))}
        self.known = []
        names = sorted(x for x in done if x.endswith(".json"))
        if names:
            texts = spark.read.text([f"{self.path}/{x}" for x in names], wholetext=True).collect()
            self.known = sorted((json.loads(r.value) for r in texts), key=lambda e: e["n"])
        for n, e in enumerate(self.known):
            if e["n"] != n:
                raise ValueError(f"{path}: evaluation {n} is missing")

    def answer(self, kind: str, asked, compute):
        """The logged answer to this question, or compute()'s, which is then logged. Both are lists and numbers."""
        if self.at < len(self.known):
            e = self.known[self.at]
            if e["kind"] != kind or e["asked"] != asked:
                raise ValueError(f"{self.path}: evaluation {self.at} is that of another fit")
            self.at += 1
            return e["answer"]
        found = compute()
        target = self.hadoop.Path(f"{self.path}/{self.at:08d}.json")
        part = self.hadoop.Path(f"{self.path}/{self.at:08d}.part")
        out = self.files.create(part, True)
        out.write(bytearray(json.dumps({"n": self.at, "kind": kind, "asked": asked, "answer": found}).encode()))
        out.close()
        self.files.rename(part, target)
        self.at += 1
        self.known.append({"n": self.at - 1, "kind": kind, "asked": asked, "answer": found})
        return found
