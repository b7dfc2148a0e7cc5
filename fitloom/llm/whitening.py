"""Whitening of vectors by matrix-free block Lanczos.

Entries become whole numbers, equal vectors count once in the fit. The covariance is never built: one pass over the
fit list gives V times a block, as a row of sums per task. Blocks are orthogonalised against all earlier ones,
twice; where a block loses rank, new random directions take the place of what is lost. The basis grows until the
residuals of the leading pairs are below a tolerance, or it spans the space. The sum of squared deviations is the
trace, so shares need no further eigenvalue.

Vectors are centred before anything is multiplied: x - floor(S/n) is whole and small, the rest of the mean a
fraction below 1, so that a large common offset costs no digits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, stage

COMPONENTS = 16
BLOCK = 8
STEP = 64
OFFSET = 1_000_000
TOLERANCE = 1e-13  # residual of a pair, as a share of the largest eigenvalue
LIMIT = 2.0**52  # entries times STEP below this are whole numbers that a double holds
_CELLS = 1 << 21  # numbers of a slice of rows that are worked on at once
_LEAST = 1e-12  # eigenvalues below this share of the largest count as zero


@dataclass
class Whitening:
    """n fit vectors of mean base + rest / n; eigenvalues falling, eigenvectors in columns; passes made."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest / self.n

    @property
    def scale(self) -> np.ndarray:
        """1 / sqrt(e); NaN for components without variance."""
        with np.errstate(all="ignore"):
            return np.where(self.values > _LEAST * self.values[:1].max(initial=0), 1 / np.sqrt(self.values), np.nan)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors * self.scale)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums of (n x - S)^2, exact; null where a long can't hold them."""
        with np.errstate(over="ignore"):  # whole numbers wrap, so sums that fit are right
            t = np.int64(self.n) * (x - self.base) - self.rest
            total = (t * t).sum(1)
        near = ((self.n * self.centred(x)) ** 2).sum(1) / 2.0**63
        out = total.astype(object)
        out[near > 1 + 1e-6] = None
        for i in np.flatnonzero(np.abs(near - 1) <= 1e-6):
            exact = sum((self.n * (int(v) - int(b)) - int(r)) ** 2 for v, b, r in zip(x[i], self.base, self.rest))
            out[i] = exact if exact < 1 << 63 else None
        return pa.array(out, pa.int64())


def whole(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id and x, floor(STEP c) + OFFSET of every entry c, of rows whose vector is whole and finite."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LIMIT / STEP))
    x = F.transform(v, lambda c: F.floor(c * STEP) + F.lit(OFFSET).cast("long"))
    return rows.filter(v.isNotNull() & ~bad).select(F.col(id_col).alias("id"), x.alias("x"))


def matrices(batches):
    """(batch, rows of x as a matrix) of slices of a bounded size."""
    for b in batches:
        width = b.column("x").flatten()
        d = len(width) // max(1, b.num_rows)
        step = max(1, _CELLS // max(1, d))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)


def summed(rows: DataFrame, size: int, add) -> np.ndarray:
    """add(x), an array of `size` sums, over all rows: a row of sums per task, added up by Spark."""

    def run(batches):
        total = np.zeros(size)
        for _, x in matrices(batches):
            total += add(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "s"])

    out = np.zeros(size)
    for r in rows.select("x").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        out[r.i] = r.s
    return out


def totals(rows: DataFrame, d: int) -> list:
    """Exact sums of every dimension, by halves of 26 bits that no long overflows."""

    def run(batches):
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in matrices(batches):
            high += (x >> 26).sum(0)
            low += (x & ((1 << 26) - 1)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(high), pa.array(low)], ["i", "high", "low"])

    sums = rows.select("x").mapInArrow(run, "i int, high long, low long").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    out = [0] * d
    for r in sums.collect():
        out[r.i] = (r.high << 26) + r.low
    return out


def orthonormal(w: np.ndarray, q: np.ndarray, size: float, random: np.random.Generator) -> tuple:
    """(block, lost): an orthonormal basis of w beside q's columns. Directions of w below 1e-12 `size` are lost, and
    random ones take their place as far as the space has room."""
    want = min(w.shape[1], len(q) - q.shape[1])
    w = w - q @ (q.T @ w)
    u, s, _ = np.linalg.svd(w, full_matrices=False)
    block = u[:, s > max(1e-12 * size, 1e-300)][:, :want]
    kept = block.shape[1]
    block = np.column_stack([block, random.normal(size=(len(q), want - kept))])
    for _ in range(3):
        block = np.linalg.qr(block - q @ (q.T @ block))[0]
    return block, kept < want


def lanczos(multiply, d: int, want: int, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 0) -> tuple:
    """(values, vectors, passes): the `want` leading eigenpairs of the symmetric d x d matrix behind multiply(block).

    Pairs are accepted once their residuals are small in two passes, and in two after a first restart, so that
    directions which it brought in have been multiplied; restarts that follow it at once bring in nothing else."""
    random, want = np.random.default_rng(seed), min(want, d)
    q, aq, size, passes, calm, restarted = np.zeros((d, 0)), np.zeros((d, 0)), 0.0, 0, 0, False
    following, _ = orthonormal(random.normal(size=(d, min(block, d))), q, 1.0, random)
    while True:
        product = multiply(following)
        q, aq, passes = np.column_stack([q, following]), np.column_stack([aq, product]), passes + 1
        h = q.T @ aq
        e, s = np.linalg.eigh((h + h.T) / 2)
        e, s = e[::-1][:want], s[:, ::-1][:, :want]
        size = max(size, float(np.abs(e).max()))
        residual = np.linalg.norm(aq @ s - (q @ s) * e, axis=0)
        calm = calm + 1 if q.shape[1] >= want and residual.max() <= tolerance * size else 0
        if q.shape[1] >= d or calm >= 2:
            return e, q @ s, passes
        following, lost = orthonormal(product, q, size, random)
        calm = 0 if lost and not restarted else calm
        restarted = lost


def fit(rows: DataFrame, d: int, n: int, components: int = COMPONENTS, block: int = BLOCK) -> Whitening:
    """Whitening of n rows of column x, d whole numbers each; a pass per block of the basis, one to check."""
    sums = totals(rows, d)
    model = Whitening(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64), np.zeros(0), np.zeros((d, 0)), 0.0, 0)

    def multiply(v):
        def add(x):
            c = model.centred(x)
            return np.concatenate([(c.T @ (c @ v)).ravel(), [(c * c).sum()]])

        out = summed(rows, v.size + 1, add) / n
        model.trace = float(out[-1])
        return out[:-1].reshape(v.shape)

    model.values, vectors, model.passes = lanczos(multiply, d, components, block)
    model.values = np.maximum(model.values, 0)
    model.vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    good = np.flatnonzero(np.isfinite(model.scale))
    if len(good):
        m = len(good)

        def add(x):
            w = model.whitened(x)[:, good]
            return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

        out = summed(rows, m * m + m, add) / n
        model.identity_error = float(np.abs(out[: m * m].reshape(m, m) - np.outer(out[m * m :], out[m * m :]) - np.eye(m)).max())
    return model


def applied(rows: DataFrame, model: Whitening, id_col: str) -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error: a row per row and component."""
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        m = len(model.values)
        share = np.where(np.isfinite(model.scale), model.values, 0) / model.trace if model.trace > 0 else np.full(m, np.nan)
        for part, x in matrices(batches):
            w, k = model.whitened(x).ravel(), part.num_rows
            again = pa.array(np.repeat(np.arange(k), m))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(again), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), pa.array(np.full(k * m, model.n)), model.deviations(x).take(again),
                    pa.array(w, mask=np.isnan(w)), pa.array(np.tile(share, k), mask=np.isnan(np.tile(share, k))), pa.array([model.identity_error] * (k * m), pa.float64()),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    out = rows.select("id", "x").mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """<id_col>, component, n, deviation, whitened, explained, identity_error: a row per row of df and component.

    Vectors that are null, or hold a null, non-finite entry or one of 2^46 or more, take no part; all other rows do,
    null and repeated ids too, each on its own. Equal vectors count once in the fit. Vectors of different lengths are
    fitted apart, each length as if alone. A vector shorter than `components` has a component per entry; one
    without entries gives no row. A component without variance (all of them, if all vectors are equal) has a null
    whitened value and a share of 0, or null if nothing varies; identity_error is over the others, null without
    any. A deviation that no long holds is null. An empty table gives no rows. Extra columns are ignored.
    """
    rows = stage(whole(df, id_col, vector), "whitening-rows")
    distinct = stage(rows.select("x").distinct(), "whitening-fit")
    size = F.size("x")
    done = None
    for r in distinct.groupBy(size.alias("d")).agg(F.count("*").alias("n")).filter("d > 0").orderBy("d").collect():  # a row per length
        model = fit(distinct.filter(size == r.d), r.d, r.n, components, block)
        part = applied(rows.filter(size == r.d), model, id_col)
        done = part if done is None else done.unionByName(part)
    if done is None:
        empty = Whitening(1, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0, 0)
        return applied(rows.limit(0), empty, id_col)
    return done


def op11_whitening(spark, sf_dir) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
