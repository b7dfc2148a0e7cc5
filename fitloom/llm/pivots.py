"""Exact top-k by inner product over a pivot-distance index.

Every distinct vector is keyed by its nearest pivot and its distance r to it. The rows of a pivot, cut by r into
bins, form annuli; neighbouring thin annuli are merged, thick ones dealt into tiles. With d = |q - p|, no x of an
annulus r0 <= r <= r1 with |x|^2 <= m lies nearer to q than g = max(0, r0 - d, d - r1), so
q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= (|q|^2 + m - g^2) / 2, and q.x <= q.p + |q| r1, and q.x <= |q| sqrt(m).

A query expands its annuli by falling bound, in rounds of eightfold width: it meets the tiles of a round in an
equi-join, its best are merged, and it stops where the next bound lies below its k-th score. Bounds that equal it
are still met, so ties are whole. Nothing is dropped: the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW, numbered, read, sample_by_hash, stage, unstage
from .exponion import whole
from .neighbours import classes

K = 10
EVERY = 100
PIVOTS = 64
FIT = 4096  # vectors, about, that pivots are placed by
BINS = 64
BLOCK = QUERY_BLOCK = 8192
WIDER = 8
_STEP = 512  # queries of a slice whose bounds or scores are worked on at once
_FLOAT = 2.0**51


def placed(sample: np.ndarray, pivots: int, seed: int = 0) -> np.ndarray:
    """Pivots among a sample: the farthest from those before, then three rounds of means."""
    x = sample.astype(np.float64)
    p = x[:1]
    gap = ((x - p[0]) ** 2).sum(1)
    while len(p) < pivots and gap.max() > 0:
        p = np.vstack([p, x[gap.argmax()]])
        gap = np.minimum(gap, ((x - p[-1]) ** 2).sum(1))
    for _ in range(3):
        near = distances(x, p).argmin(1)
        p = np.array([x[near == j].mean(0) if (near == j).any() else p[j] for j in range(len(p))])
    return p


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of rows, in double precision; sums of differences, since products would cancel."""
    return np.stack([np.sqrt(((x - own) ** 2).sum(1)) for own in p], axis=1)


def by_length(table, column: str = "vec"):
    """(rows' numbers, their vectors as a matrix) of each vector length."""
    dims = np.diff(table.column(column).offsets.to_numpy())
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), at, table.column(column).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def keyed(known: DataFrame, pivots: dict) -> DataFrame:
    """known with pivot (the nearest), r (distance to it) and square (squared norm)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(lo, 1 << 12)
                pivot, r, square = np.zeros(part.num_rows, np.int32), np.zeros(part.num_rows), np.zeros(part.num_rows)
                for d, at, x in by_length(part):
                    gaps = distances(x.astype(np.float64), pivots[d])
                    pivot[at] = gaps.argmin(1)
                    r[at] = gaps[np.arange(len(at)), pivot[at]]
                    square[at] = (x.astype(np.float64) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pivot), pa.array(r), pa.array(square)], [*part.schema.names, "pivot", "r", "square"])

    return known.mapInArrow(run, "key long, dim int, vec array<bigint>, ids array<bigint>, least long, pivot int, r double, square double")


class Annuli:
    """Of one vector length: annuli by number, with pivot, r0, r1, most (largest squared norm), n and tiles."""

    def __init__(self, bins: list, pivots: np.ndarray, block: int):
        self.pivots, self.of = pivots, {}
        made: list = []
        for b in sorted(bins, key=lambda b: (b.pivot, b.bin)):
            last = made[-1] if made else None
            if last and last[0] == b.pivot and last[4] + b.n <= block:
                last[2], last[3], last[4] = max(last[2], b.r1), max(last[3], b.most), last[4] + b.n
            else:
                made.append([b.pivot, b.r0, b.r1, b.most, b.n])
            self.of[b.pivot, b.bin] = len(made) - 1
        self.pivot, self.n = np.array([m[0] for m in made], int), np.array([m[4] for m in made], np.int64)
        self.r0, self.r1, self.most = (np.array([m[i] for m in made]) for i in (1, 2, 3))
        self.tiles = -(-self.n // block)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries, annuli): no inner product with a row of the annulus is larger."""
        q = q.astype(np.float64)
        d, dot, square = distances(q, self.pivots)[:, self.pivot], (q @ self.pivots.T)[:, self.pivot], (q * q).sum(1)[:, None]
        norm = np.sqrt(square)
        gap = np.maximum(0, np.maximum(self.r0 - d, d - self.r1))
        high = np.minimum((square + self.most - gap * gap) / 2, dot + norm * self.r1)
        return np.minimum(high, norm * np.sqrt(self.most)) + 1e-9 * (square + self.most + norm * (d + self.r1)) + 1e-6

    def expand(self, q: np.ndarray, floor: np.ndarray, lo: int, hi: int):
        """(query, annulus, bound) of the annuli that come lo to hi rows into the queries' lists and reach their floors."""
        bound = self.bounds(q)
        order = np.argsort(-bound, axis=1, kind="stable")
        n = self.n[order]
        before = n.cumsum(1) - n
        i, at = np.nonzero((before >= lo) & (before < hi) & (np.take_along_axis(bound, order, 1) >= floor[:, None]))
        return i, order[i, at]


def indexed(known: DataFrame, pivots: int) -> tuple:
    """(table of the classes with annulus and tile, Annuli of each vector length)."""
    sample: dict = {}
    for r in sample_by_hash(known, F.xxhash64("key"), FIT).select("dim", "vec").limit(2 * FIT).collect():
        sample.setdefault(r.dim, []).append(r.vec)
    dims = [r.dim for r in known.select("dim").distinct().collect()]  # a row per vector length
    points = {d: placed(np.array(sample[d]).reshape(-1, d), pivots) if d in sample else np.zeros((1, d)) for d in dims}
    table = stage(keyed(known, points), "pivot-keys")
    reach = table.groupBy("dim", "pivot").agg(F.min("r").alias("from"), F.max("r").alias("to"))  # at most `pivots` rows a length
    step = F.greatest((F.col("to") - F.col("from")) / BINS, F.lit(1e-9))
    binned = table.join(F.broadcast(reach), ["dim", "pivot"]).withColumn("bin", F.least(F.floor((F.col("r") - F.col("from")) / step), F.lit(BINS - 1)).cast("int")).drop("from", "to")
    each = binned.groupBy("dim", "pivot", "bin").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.max("square").alias("most"), F.count("*").alias("n"))
    bins: dict = {}
    for r in each.collect():  # at most pivots x BINS rows a length
        bins.setdefault(r.dim, []).append(r)
    annuli = {d: Annuli(b, points[d], BLOCK) for d, b in bins.items()}
    numbers = [(d, p, b, a, int(o.tiles[a])) for d, o in annuli.items() for (p, b), a in o.of.items()]
    spark = known.sparkSession
    number = spark.createDataFrame(numbers, "dim int, pivot int, bin int, annulus int, tiles long")
    dealt = binned.join(F.broadcast(number), ["dim", "pivot", "bin"]).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")))
    return stage(dealt.select("key", "dim", "vec", "ids", "least", "annulus", "tile"), "pivot-index"), annuli


def meetings(asks: DataFrame, annuli: dict, slices: int, lo: int, hi: int) -> DataFrame:
    """dim, annulus, tile, slice, key, vec, floor of the tiles that each query meets in this round."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                floor = part.column("floor").to_numpy(zero_copy_only=False)
                for d, rows, q in by_length(part):
                    i, a = annuli[d].expand(q, floor[rows], lo, hi)
                    tiles = annuli[d].tiles[a]
                    i, a, tile = np.repeat(i, tiles), np.repeat(a, tiles), np.concatenate([np.arange(t) for t in tiles] + [np.zeros(0, np.int64)])
                    for cut in range(0, len(i), 1 << 14):
                        own = part.take(pa.array(rows[i[cut : cut + (1 << 14)]]))
                        yield pa.RecordBatch.from_arrays(
                            [own.column("dim"), pa.array(a[cut : cut + (1 << 14)].astype(np.int32)), pa.array(tile[cut : cut + (1 << 14)].astype(np.int64)), own.column("key"), own.column("vec"), own.column("floor")],
                            ["dim", "annulus", "tile", "key", "vec", "floor"],
                        )

    met = asks.select("key", "dim", "vec", "floor").mapInArrow(run, "dim int, annulus int, tile long, key long, vec array<bigint>, floor double")
    return met.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices)))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    a, b = q.astype(np.float64), x.astype(np.float64)
    if np.sqrt((a * a).sum(1).max(initial=0) * (b * b).sum(1).max(initial=0)) < _FLOAT:
        return (a @ b.T).astype(np.int64)
    return q @ x.T


def best(s: np.ndarray, floor: np.ndarray, ids: list, want: int, several: bool):
    """(query, row) of rows that can hold the `want` best ids of their query; rows are sorted by their least ids."""
    if several:  # ids with several vectors: rows by falling score until their least ids are enough different ones
        for i in range(len(s)):
            seen: set = set()
            for j in np.argsort(-s[i], kind="stable"):
                if s[i, j] < floor[i] or len(seen) >= want:
                    break
                yield i, j
                seen.add(ids[j][0])
        return
    m = min(want, s.shape[1])
    least = np.maximum(np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m], floor)
    i, j = np.nonzero(s >= least[:, None])
    order = np.lexsort((j, -s[i, j], i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, np.arange(len(s)))
    keep = np.arange(len(i)) - first[i] < m
    yield from zip(i[keep], j[keep])


def found(index: DataFrame, met: DataFrame, want: int, several: bool) -> DataFrame:
    """key, id, score: what each query finds in the tiles it meets, at least its `want` best ids there."""
    on = ["dim", "annulus", "tile"]
    rows = index.join(met.select(*on, "slice").distinct(), on)
    none = lambda t: F.lit(None).cast(t)
    both = rows.select(*on, "slice", F.lit(False).alias("query"), "key", "vec", "ids", "least", none("double").alias("floor")).unionByName(
        met.select(*on, "slice", F.lit(True).alias("query"), "key", "vec", none("array<bigint>").alias("ids"), none("bigint").alias("least"), "floor")
    )

    def run(table):  # about BLOCK rows and at most about QUERY_BLOCK queries
        table = table.combine_chunks()
        of = table.column("query").to_numpy()
        asks, own = table.filter(pa.array(of)), table.filter(pa.array(~of)).sort_by("least")
        matrix = lambda t: np.asarray(t.column("vec").combine_chunks().flatten()).reshape(t.num_rows, -1)
        key, ids, score = [], [], []
        if asks.num_rows and own.num_rows:
            q, x, keys, floor, names = matrix(asks), matrix(own), asks.column("key").to_pylist(), asks.column("floor").to_numpy(), own.column("ids").to_pylist()
            for at in range(0, len(q), _STEP):
                s = scores(q[at : at + _STEP], x)
                for i, j in best(s, floor[at : at + _STEP], names, want, several):
                    key.append(keys[at + i])
                    ids.append(names[j])
                    score.append(int(s[i, j]))
        return pa.table([pa.array(key, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(score, pa.int64())], ["key", "ids", "score"])

    hits = both.groupBy(*on, "slice").applyInArrow(run, "key long, ids array<bigint>, score long")
    return hits.select("key", F.explode("ids").alias("id"), "score")


def search(df: DataFrame, query, k: int = K, id_col: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, watch=None) -> DataFrame:
    """query_id, rank, <id_col>, score: the k rows with the highest inner products of floor(1024 x), for every row
    that `query`, a condition on the id column `id`, selects; never the row itself.

    Vectors that are null, empty, or hold null or non-finite numbers, or so long that products may not fit a long (a
    norm near 2^20) take no part, nor do null ids; zero vectors do. Only vectors of one length are compared. Rows repeated
    with the same id and vector count once; an id with several vectors, as query or row, is listed once with its
    best score. Ties go to the smaller id. Fewer candidates than k give fewer rows; an empty table gives none. Extra
    columns are ignored. watch(round, meetings of a query and a tile) is told what each round took.
    """
    good = stage(whole(df.filter(F.col(id_col).isNotNull()), id_col, vector, None).select(F.col("id").cast("long").alias("id"), F.col("x").alias("vec")).filter(F.size("vec") > 0).distinct(), "pivot-rows")
    known = numbered(classes(good, k), "pivot-classes").withColumnRenamed(ROW, "key")
    known = known.select("key", "dim", "vec", "ids", "least")
    index, annuli = indexed(known, pivots)
    ids = stage(good.filter(query).join(known.select("key", "vec"), "vec").select("id", "key"), "pivot-asks")
    asks = stage(known.join(ids.select("key").distinct(), "key", "left_semi").select("key", "dim", "vec"), "pivot-queries")
    several = good.groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] > 1
    slices = max(1, -(-asks.count() // QUERY_BLOCK))
    most = max((int(a.n.sum()) for a in annuli.values()), default=0)
    top, lo, hi, turn = good.sparkSession.createDataFrame([], "key long, id long, score long"), 0, BLOCK, 0
    while lo < most:
        floor = top.groupBy("key").agg(F.min("score").cast("double").alias("s"), F.count("*").alias("n")).filter(F.col("n") > k)
        ready = asks.join(floor, "key", "left").select("key", "dim", "vec", F.coalesce("s", F.lit(float("-inf"))).alias("floor"))
        met = stage(meetings(ready, annuli, slices, lo, hi), "pivot-met")
        if watch:
            watch(turn, met.count())
        each = top.unionByName(found(index, met, k + 1, several))
        each = each.groupBy("key", "id").agg(F.max("score").alias("score")) if several else each
        rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "id"))
        new = stage(each.withColumn("r", rank).filter(F.col("r") <= k + 1).drop("r"), "pivot-top")
        unstage(met)
        unstage(top)
        top, lo, hi, turn = new, hi, hi * WIDER, turn + 1
    pairs = ids.select(F.col("id").alias("query_id"), "key").join(top, "key").filter("id != query_id")
    pairs = pairs.groupBy("query_id", "id").agg(F.max("score").alias("score")) if several else pairs
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op13_topk(spark, sf_dir) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0)
