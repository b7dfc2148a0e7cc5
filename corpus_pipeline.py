"""From documents to packed training sequences: a chain of five operators, each stage on what is left.

1. toxicity: documents that the model scores 0.5 or more go.
2. simhash: of each group of near-duplicates the document with the smallest id stays.
3. secrets: findings are replaced by REDACTED; n_chars follows.
4. mixing: documents are repeated, or left out, to meet their source's target weight.
5. packing: token pieces with their place in sequences of 4096.

Every stage takes any table with the columns of documents, in any order; other columns are dropped. Rows are
told apart by numbers of their own, so null and repeated ids and repeated rows (ties) are decided row by row.
Null and empty texts are clean, near copies of each other, hold no secrets, have no words to mix and one token
to pack. Very long texts are read whole. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.llm import common, mixing, packing, secrets, simhash
from fitloom.llm import toxicity as tox

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REDACTED = "[REDACTED]"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the documents at hand; keeps what it scores below 0.5. Null and empty texts score 0."""
    model = tox.learn(docs, common.read(spark, sf_dir, "labels"))
    return tox.scored(docs, model, COLUMNS, locate=False).filter("score < 0.5").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of fingerprints stays: the smallest id, of equal or no ids the first row. Wordless texts are one component."""
    return simhash.representatives(docs.select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every finding is replaced; documents without one, null texts among them, are untouched."""
    out = secrets.scan(docs, secrets.train(docs), COLUMNS, REDACTED)
    n = F.when(F.size("findings") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated by their copies; a row without words has none."""
    return mixing.mixed_rows(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset; every row has one at least."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxicity), ("simhash", near_dedup), ("secrets", redact), ("mixing", mix), ("packing", pack)]

#: Stages 1, 3 and 5 learn models or pack by best fit, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = common.stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
