"""k-means over whole numbers by exponion search.

Each vector carries an upper bound u of its distance to its centroid a and a lower bound l of that to any other.
Centroids that move widen the bounds. A vector stays without a look if u is less than l, or than half the way s
from a to the nearest other centroid. Otherwise u is made exact, and if that does not do, only centroids inside the
ball of radius 2 u + s around a are scanned, nearest first from a's sorted list. The radius is inclusive and tests
to stay are strict, so that ties are seen; distances are exact whole numbers, and bounds are rounded outwards.

Vectors with their bounds are a table in the shared folder, written anew each round; sums change by the vectors that
moved. Only centroids, k of them, pass through the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, stage, unstage

CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
STEP = 1024
SEED = 3
LIMIT = 2.0**60  # squared norms below this keep squared distances in a long
_FLOAT = 2.0**51  # squared norms below this keep products and squared distances exact in doubles
_OUT, _IN = 1 + 1e-9, 1 - 1e-9
_CELLS = 1 << 21


def whole(rows: DataFrame, id_col: str, vector: str, dimensions: int | None = DIMENSIONS) -> DataFrame:
    """id and x, floor(STEP c) of every entry c, of rows with a finite vector of that many entries."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= 2.0**30 / STEP))
    fits = F.aggregate(v, F.lit(0.0), lambda s, c: s + (F.abs(c) * STEP + 1) * (F.abs(c) * STEP + 1)) < LIMIT
    ok = v.isNotNull() & ~bad & fits
    if dimensions is not None:
        ok = ok & (F.size(v) == dimensions)
    return rows.filter(ok).select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c * STEP)).alias("x"))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of x, rows of c) of whole numbers."""
    xf, cf = x.astype(np.float64), c.astype(np.float64)
    xx, cc = (xf * xf).sum(1), (cf * cf).sum(1)
    if max(xx.max(initial=0), cc.max(initial=0)) < _FLOAT:
        return (xx[:, None] - 2 * (xf @ cf.T) + cc).astype(np.int64)
    return np.stack([((x - own) ** 2).sum(1) for own in c], axis=1)


class Centroids:
    """k centroids, their neighbours sorted by distance, and how far each came from its last place."""

    def __init__(self, c: np.ndarray, before: np.ndarray | None = None):
        self.c, k = c, len(c)
        apart = np.sqrt(squares(c, c).astype(np.float64))
        np.fill_diagonal(apart, -1.0)  # a centroid heads its own list, also among equal ones
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(np.maximum(apart, 0), self.order, 1) * _IN
        self.s = self.apart[:, 1] if k > 1 else np.full(k, np.inf)
        self.drift = np.zeros(k) if before is None else np.sqrt(((c - before) ** 2).sum(1).astype(np.float64)) * _OUT
        top = np.argsort(self.drift)[::-1]
        self.others = np.full(k, self.drift[top[0]])  # the largest drift of any other centroid
        self.others[top[0]] = self.drift[top[1]] if k > 1 else 0.0

    def scan(self, x: np.ndarray, listed: np.ndarray) -> tuple:
        """(nearest, its squared distance, squared distance of the second, -1 without one) among listed centroids."""
        d = squares(x, self.c[listed])
        best = d.min(1)
        number = np.where(d == best[:, None], listed[None, :], len(self.c)).min(1)
        if len(listed) == 1:
            return number, best, np.full(len(x), -1, np.int64)
        return number, best, np.partition(d, 1, axis=1)[:, 1]

    def reassign(self, x: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray) -> tuple:
        """(a, u, low, distances computed): where each vector belongs now. a of -1: nowhere yet."""
        a, known = a.copy(), a >= 0
        own = np.where(known, a, 0)
        u, low = np.where(known, u + self.drift[own], np.inf), np.where(known, low - self.others[own], 0.0)
        work = 0

        def settle(rows, found):
            a[rows], best, second = found
            u[rows] = np.sqrt(best.astype(np.float64)) * _OUT
            low[rows] = np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0).astype(np.float64)) * _IN)

        new = np.flatnonzero(~known)
        if len(new):
            settle(new, self.scan(x[new], np.arange(len(self.c))))
            work += len(new) * len(self.c)
        floor = np.maximum(low, self.s[own] / 2)
        doubt = np.flatnonzero(known & ~(u < floor))
        if len(doubt):
            exact = ((x[doubt] - self.c[a[doubt]]) ** 2).sum(1)
            u[doubt] = np.sqrt(exact.astype(np.float64)) * _OUT
            work += len(doubt)
            doubt = doubt[~(u[doubt] < floor[doubt])]
        for j in np.unique(a[doubt]):  # balls of one centre; sizes doubled, so that few scans serve all
            of = doubt[a[doubt] == j]
            ball = np.searchsorted(self.apart[j], (2 * u[of] + self.s[j]) * _OUT, side="right") if len(self.c) > 1 else np.ones(len(of), int)
            size = np.minimum(1 << np.ceil(np.log2(np.maximum(ball, 1))).astype(int), len(self.c))
            for m in np.unique(size):
                settle(of[size == m], self.scan(x[of[size == m]], self.order[j, :m]))
                work += int((size == m).sum()) * int(m)
        return a, u, low, work


def matrices(batches, dims: int):
    for b in batches:
        step = max(1, _CELLS // max(1, dims))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)


def assigned(rows: DataFrame, near: Centroids) -> DataFrame:
    """rows with a, u, low of this round, was (a of the last round) and the distances that were computed."""
    kind, dims = dict(rows.dtypes)["id"], near.c.shape[1]

    def run(batches):
        for part, x in matrices(batches, dims):
            was = part.column("a").to_numpy()
            a, u, low, work = near.reassign(x, was, part.column("u").to_numpy(), part.column("low").to_numpy())
            count = np.zeros(len(a), np.int64)
            count[:1] = work
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("x"), pa.array(a.astype(np.int32)), pa.array(was), pa.array(a != was), pa.array(u), pa.array(low), pa.array(count)],
                ["id", "x", "a", "was", "moved", "u", "low", "work"],
            )

    return rows.select("id", "x", "a", "u", "low").mapInArrow(run, f"id {kind}, x array<bigint>, a int, was int, moved boolean, u double, low double, work long")


def moves(rows: DataFrame, k: int, dims: int) -> tuple:
    """(sums, counts): what the vectors that moved add to and take from each centroid's."""

    def run(batches):
        total = np.zeros((k, dims + 1), np.int64)
        for part, x in matrices(batches, dims):
            x = np.column_stack([x, np.ones(len(x), np.int64)])
            a, was = part.column("a").to_numpy(), part.column("was").to_numpy()
            for j in np.unique(np.concatenate([a, was[was >= 0]])):
                total[j] += x[a == j].sum(0) - x[was == j].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["i", "s"])

    sums = rows.filter("moved").select("x", "a", "was").mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = [0] * (k * (dims + 1))
    for r in sums.collect():
        out[r.i] = int(r.s)
    each = [out[j * (dims + 1) : (j + 1) * (dims + 1)] for j in range(k)]
    return [e[:-1] for e in each], [e[-1] for e in each]


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least SHA-256 of "<seed>:<id>"; then by vector, null ids last."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return np.array([r.x for r in rows.select(h.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()], np.int64)


def cluster(
    df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED, watch=None,
) -> DataFrame:
    """<id_col>, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row per vector.

    Vectors without exactly `dimensions` entries, null, with a null or non-finite entry, or so long that squared
    distances may not fit a long (a norm near 2^20) take no part. All other rows do, each on its own, with null and
    repeated ids and equal vectors; ids shared by several vectors start by the lesser vector, null ids last. Ties go
    to the smaller number; empty clusters keep their centroid. Fewer vectors than clusters give fewer
    centroids; an empty table no rows. A sum that no long holds is null. Extra columns are ignored.
    watch(round, distances computed) is told what each round cost; the last round is the final assignment.
    """
    now = stage(whole(df, id_col, vector, dimensions), "exponion-rows")
    c = starts(now, clusters, seed)
    if not len(c):
        none = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return now.sparkSession.createDataFrame([], f"id {dict(now.dtypes)['id']}, {none}").withColumnRenamed("id", id_col)
    k, before = len(c), None
    sums, counts = [[0] * dimensions for _ in range(k)], [0] * k
    last, rows = now, now.select("id", "x", F.lit(-1).alias("a"), F.lit(0.0).alias("u"), F.lit(0.0).alias("low"))
    for i in range(rounds):
        rows = stage(assigned(rows, Centroids(c, before)), "exponion-round")
        unstage(last)
        last = rows
        if watch:
            watch(i, rows.agg(F.sum("work")).first()[0])
        more, of = moves(rows, k, dimensions)
        sums = [[s + m for s, m in zip(a, b)] for a, b in zip(sums, more)]
        counts = [a + b for a, b in zip(counts, of)]
        before, c = c, np.array([[s // counts[j] for s in sums[j]] if counts[j] else c[j].tolist() for j in range(k)], np.int64)
    final = assigned(rows, Centroids(c, before))

    def measure(batches):
        for part, x in matrices(batches, dimensions):
            a = part.column("a").to_numpy()
            d = ((x - c[a]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("a"), pa.array(d), part.column("work")], ["id", "cluster", "distance", "work"])

    kind = dict(now.dtypes)["id"]
    done = stage(final.mapInArrow(measure, f"id {kind}, cluster int, distance long, work long"), "exponion-last")
    unstage(last)
    if watch:
        watch(rounds, done.agg(F.sum("work")).first()[0])
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    found = {r.cluster: r.s for r in done.groupBy("cluster").agg(wide.alias("s")).collect()}
    fits = lambda v: int(v) if v < 1 << 63 else None
    table = [(j, fits(s), fits(sum(found.values())), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j, s in found.items()]
    each = now.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = done.join(F.broadcast(each), "cluster")  # a row per cluster
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark, sf_dir) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"))
