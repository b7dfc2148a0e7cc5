"""Nearest neighbours of a query set by a block matrix join with int8 tiles.

Vectors are normalised and quantised once, v = s q + e with int8 q and known |e|, and travel as their bytes, s and
|e|. Blocks of queries meet blocks of candidates in an equi-join on the tile's number; a tile's integer
products give every cosine within |e_a| + (1 + |e_a|) |e_b|, and pairs whose upper bound reaches the tile's
k-th best lower bound of their query survive. Survivors below the k-th best lower bound of all tiles go; the
others meet the original vectors, are recomputed in double precision and go through a heap per query.
Nothing is lost: the result is exact.

Equal vectors are one class with its k + 1 smallest ids, so copies neither multiply pairs nor crowd out.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW, numbered, partitions, read, stage, unstage

K = 5
EVERY = 50
BLOCK = QUERY_BLOCK = 8192
_STEP = 1024  # queries of a tile that are multiplied at once
_EXACT = 1024  # dimensions whose int8 products sum exactly in float32


def quantise(x: np.ndarray) -> tuple:
    """(int8 rows, scale, |error|) of unit rows."""
    scale = np.abs(x).max(1, keepdims=True) / 127
    q = np.rint(x / scale)
    return q.astype(np.int8), scale[:, 0], np.linalg.norm(x - q * scale, axis=1) + 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Unit rows, scaled first so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows."""
    out = None
    for lo in range(0, a.shape[1], _EXACT):
        part = a[:, lo : lo + _EXACT].astype(np.float32) @ b[:, lo : lo + _EXACT].astype(np.float32).T
        out = part if out is None else out.astype(np.float64) + part
    return out


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision, the same for the same two vectors wherever they stand."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def bounds(a: tuple, b: tuple) -> tuple:
    """Lower and upper bounds of the cosines of quantised rows a and b, each (int8 rows, scale, |error|)."""
    near = products(a[0], b[0]) * a[1][:, None] * b[1][None, :]
    slack = a[2][:, None] + (1 + a[2][:, None]) * b[2][None, :]
    return near - slack, near + slack


def tile(queries: tuple, rows: tuple, k: int):
    """(query, row, lower, upper) of every pair whose upper bound reaches its query's k-th best lower bound."""
    kk = min(k, len(rows[1]))
    for at in range(0, len(queries[1]), _STEP):
        low, high = bounds(tuple(x[at : at + _STEP] for x in queries), rows)
        floor = -np.partition(-low, kk - 1, axis=1)[:, kk - 1]
        i, j = np.nonzero(high >= floor[:, None])
        yield i + at, j, low[i, j], high[i, j]


def usable(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id and vec of rows with an id and a finite, non-zero vector."""
    v = F.col(vector)
    v = v if dict(rows.dtypes)[vector] in ("array<float>", "array<double>") else v.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return rows.filter(F.col(id_col).isNotNull() & v.isNotNull() & ~bad & some).select(F.col(id_col).cast("long").alias("id"), v.alias("vec"))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """vec, dim, ids (the k + 1 least) and least (the first of them) of each distinct vector."""
    rank = W.partitionBy("vec").orderBy("id")
    few = rows.distinct().withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= k + 1)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("vec", F.size("vec").alias("dim"), "ids", F.col("ids")[0].alias("least"))


def quantised(known: DataFrame) -> DataFrame:
    """key, dim, q (int8 bytes), s and e of every class."""

    def run(batches):
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            for d in np.unique(dim):  # vectors of one length together
                own = batch.filter(pa.array(dim == d))
                q, s, e = quantise(unit(own.column("vec").flatten().to_numpy().astype(np.float64).reshape(own.num_rows, -1)))
                cells = pa.array([x.tobytes() for x in q], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column("key"), own.column("dim"), cells, pa.array(s), pa.array(e)], ["key", "dim", "q", "s", "e"])

    return known.select("key", "dim", "vec").mapInArrow(run, "key long, dim int, q binary, s double, e double")


def survivors(tiles: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """key, other, low, high: of each asked class the pairs that can be among its k nearest classes."""
    spark = tiles.sparkSession
    sizes = tiles.groupBy("dim").agg(F.count("*").alias("n")).collect()  # a row per vector length
    ask = tiles.join(asked, "key", "left_semi")
    m = {r.dim: -(-r.m // QUERY_BLOCK) for r in ask.groupBy("dim").agg(F.count("*").alias("m")).collect()}
    grid = [(r.dim, -(-r.n // BLOCK), m[r.dim]) for r in sizes if r.dim in m]
    table = spark.createDataFrame(grid, "dim int, rows int, cols int")
    block = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    tiled = lambda df, own, other, query: df.join(table, "dim").select(
        "dim", block(own).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other).cast("long") - 1)).alias(other), F.lit(query).alias("query"), "key", "q", "s", "e"
    )
    both = tiled(tiles, "rows", "cols", False).unionByName(tiled(ask, "cols", "rows", True))

    def run(table):  # one tile: about BLOCK candidates and QUERY_BLOCK queries
        of, keys = table.column("query").to_numpy(), table.column("key").to_numpy()
        q = np.frombuffer(b"".join(table.column("q").to_pylist()), np.int8).reshape(len(keys), -1)
        s, e = table.column("s").to_numpy(), table.column("e").to_numpy()
        side = lambda x: (q[x], s[x], e[x])
        out: list = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]]
        if of.any() and not of.all():
            for i, j, low, high in tile(side(of), side(~of), k):
                for c, x in zip(out, (keys[of][i], keys[~of][j], low, high)):
                    c.append(x)
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in out], ["key", "other", "low", "high"])

    return both.groupBy("dim", "rows", "cols").applyInArrow(run, "key long, other long, low double, high double")


def nearest(pairs: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """key, other, score: the k nearest of each key's pairs by exact cosine, ties to the class with the least id."""
    first = W.partitionBy("key").orderBy(F.desc("low"))
    floor = pairs.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).groupBy("key").agg(F.min("low").alias("floor"), F.count("*").alias("n"))
    left = pairs.join(floor, "key").filter((F.col("high") >= F.col("floor")) | (F.col("n") < k)).select("key", "other")
    left = left.join(known.select(F.col("key").alias("other"), "least", F.col("vec").alias("b")), "other").join(known.select("key", F.col("vec").alias("a")), "key")

    def run(batches):
        key, heap = None, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            dims = np.diff(batch.column("a").offsets.to_numpy())
            score = np.empty(n)
            for d in np.unique(dims):  # vectors of one length together
                at = np.flatnonzero(dims == d)
                own = batch.take(pa.array(at))
                a, b = (own.column(c).flatten().to_numpy().reshape(len(at), -1) for c in ("a", "b"))
                score[at] = cosine(a, b)
            for own, other, least, s in zip(*(batch.column(c).to_pylist() for c in ("key", "other", "least")), score.tolist()):
                if own != key:
                    if heap:
                        yield best(key, heap)
                    key, heap = own, []
                item = (s, -least, -other)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        if heap:
            yield best(key, heap)

    def best(key, heap):
        return pa.RecordBatch.from_arrays([pa.array([key] * len(heap)), pa.array([-x[2] for x in heap]), pa.array([x[0] for x in heap])], ["key", "other", "score"])

    dealt = left.repartition(partitions(pairs.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, other long, score double")


def search(rows: DataFrame, query, k: int = K, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, <id_col>, score: the k nearest rows by cosine of every row that `query`, a condition
    on the id column `id`, selects; never the row itself.

    Vectors that are null, zero or hold null or non-finite numbers take no part, nor do null ids; only
    vectors of one length are compared. Rows repeated with the same id and vector count once; an id with
    several vectors, as query or neighbour, is listed once with its best score. Ties go to the smaller id.
    Fewer candidates than k give fewer rows; an empty table gives none. Extra columns are ignored.
    """
    good = stage(usable(rows, id_col, vector), "nn-rows")
    known = numbered(classes(good, k), "nn-classes").withColumnRenamed(ROW, "key")
    tiles = stage(quantised(known), "nn-tiles")
    asks = good.filter(query).distinct().join(known.select("key", "vec"), "vec").select("id", "key")
    asks = stage(asks, "nn-asks")
    several = good.distinct().groupBy("id").agg(F.count("*").alias("c")).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0] > 1
    most = known.count() if several else 0
    done, want = [], k + 1
    while True:
        pairs = stage(survivors(tiles, asks.select("key").distinct(), want), "nn-pairs")
        top = stage(nearest(pairs, known, want), "nn-top")
        unstage(pairs)
        found = asks.select(F.col("id").alias("query_id"), "key").join(top, "key").join(known.select(F.col("key").alias("other"), "ids"), "other")
        each = found.select("query_id", "score", F.explode("ids").alias("id")).filter("id != query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
        if not several or want >= most:
            done.append(each)
            break
        # ids with several vectors may fill the lists of classes: queries with fewer than k ids ask for more classes
        each = stage(each, "nn-found")
        full = each.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"))
        done.append(each.join(full.select(F.col("id").alias("query_id")), "query_id", "left_semi"))
        asks, want = stage(asks.join(full, "id", "left_anti"), "nn-asks"), want * 4
        if asks.isEmpty():
            break
    each = done[0]
    for more in done[1:]:
        each = each.unionByName(more)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op2_neighbours(spark, sf_dir) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0)
