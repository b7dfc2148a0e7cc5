"""Mergeable fits: local fits per chunk combined by precision, and additive sums at a fixed point."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import named
from . import frame, normal, solve
from .fit import covariance
from .grouped import GROUP_ROWS, Block, advanced, linear_states, outcome_of
from .storage import written


def chunk_fits(df: DataFrame, model, x, y: str, chunk: Column, p0, sigma: str | None = None, retries: int = 2, nan_policy: str = "omit", group_rows: int = GROUP_ROWS) -> DataFrame:
    """chunk_id, n, theta, cov, success, error_type, nfev. A failed chunk is tried again from seeded perturbations.

    Chunks may have any size. Models linear in their parameters are summed where their rows are. For others, chunks of
    up to group_rows rows are fitted in a task; larger ones advance together, one grouped aggregate a step.
    """
    model = named(model)
    pts = frame.points(df.withColumn("chunk_id", chunk.cast("long")), frame.Roles.of(x, y, model.variables, sigma=sigma, keys=("chunk_id",)), nan_policy)
    lo, hi = model.limits()
    p0 = np.asarray(p0, float)

    schema = "chunk_id long, n long, theta array<double>, cov array<array<double>>, success boolean, error_type string, nfev int"
    if model.linear and model.expr is not None and len(p0) <= normal.SQL_WIDTH and not np.isfinite(np.concatenate([lo, hi])).any():

        def row(key, state):
            n, out, _, error = outcome_of(state, sigma is not None)
            if out is None:
                return key[0], n, None, None, False, "ValueError", 2
            cov, _ = covariance(out.state, sigma is not None)
            good = bool(np.isfinite(cov).all())
            return (key[0], n, out.theta.tolist() if good else None, cov.tolist() if good else None, good, None if good else "singular", 2)

        return linear_states(pts, model, ["chunk_id"], p0, row, schema)

    def attempts(key: tuple, n: int):
        """Generator of a chunk's row: the fit from p0, then from perturbations of it."""
        rng, error, nfev = np.random.default_rng(int(key[0]) & 0x7FFFFFFF), None, 0
        for i in range(retries + 1):
            try:
                start = p0 if i == 0 else p0 * (1 + 0.01 * rng.normal(size=len(p0)))
                out = yield from solve.iterate(np.clip(start, lo, hi), lo, hi)
                cov, _ = covariance(out.state, sigma is not None)
                nfev += out.nfev
                if out.success and np.isfinite(cov).all():
                    return key[0], n, out.theta.tolist(), cov.tolist(), True, None, nfev
                error = "singular" if out.success else "not converged"
            except (ValueError, np.linalg.LinAlgError) as e:
                error = type(e).__name__
        return key[0], n, None, None, False, error, nfev

    def one(key, pdf):
        v = {x: pdf[f"v_{x}"].to_numpy(float) for x in model.variables}
        problem = Block(model, v, pdf["y"].to_numpy(float), pdf["w"].to_numpy(float))
        return pd.DataFrame([solve.driven(problem, attempts(key, len(pdf)))], columns=cols)

    cols = ["chunk_id", "n", "theta", "cov", "success", "error_type", "nfev"]
    sizes = pts.groupBy("chunk_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > group_rows).collect()  # at most rows / group_rows
    if not sizes:
        return pts.groupBy("chunk_id").applyInPandas(one, schema)
    spark, large = df.sparkSession, F.broadcast(df.sparkSession.createDataFrame([(r.chunk_id,) for r in sizes], "_c long"))
    same = F.col("chunk_id").eqNullSafe(F.col("_c"))
    rows = advanced(pts.join(large, same, "left_semi"), model, {(r.chunk_id,): attempts((r.chunk_id or 0,), r._n) for r in sizes}, {"chunk_id": "long"})
    done = spark.createDataFrame([(key[0], *row[1:]) for key, row in rows.items()], schema)
    return pts.join(large, same, "left_anti").groupBy("chunk_id").applyInPandas(one, schema).unionByName(done)


def chunk_count(df: DataFrame, rows: int = 1_000_000) -> int:
    """Chunks of about `rows` rows each."""
    return max(1, -(-df.count() // rows))


def shuffled_chunk(order: Column, chunks: int, seed: int = 0) -> Column:
    """A seeded chunk number from 0 of each row: an even deal whatever the order of rows, the same for equal seeds."""
    return F.pmod(F.xxhash64(order, F.lit(seed)), F.lit(chunks))


def precisions(fits: DataFrame) -> tuple:
    """(chunks, fitted, evaluations, sum C^-1, sum C^-1 theta): one look at the fits."""

    def sums(pdf_iter):
        for pdf in pdf_iter:
            rows = [(-3, float(len(pdf))), (-2, float(pdf["success"].sum())), (-1, float(pdf["nfev"].sum()))]
            for theta, cov in zip(pdf["theta"][pdf["success"]], pdf["cov"][pdf["success"]]):
                p = np.linalg.pinv(np.array([list(r) for r in cov]))
                rows += [(i, float(v)) for i, v in enumerate(np.concatenate([p.ravel(), p @ np.array(theta)]))]
            yield pd.DataFrame(rows, columns=["i", "v"])

    got = {r.i: r.v for r in fits.select("theta", "cov", "success", "nfev").mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    v = np.array([got[i] for i in sorted(got) if i >= 0])
    k = int((-1 + np.sqrt(1 + 4 * len(v))) / 2)
    return int(got.get(-3, 0)), int(got.get(-2, 0)), int(got.get(-1, 0)), v[: k * k].reshape(k, k), v[k * k :]


def merge(fits: DataFrame, least_success: float = 0.5) -> tuple:
    """(theta, covariance): (sum C^-1)^-1 sum C^-1 theta over successful chunks, summed by Spark."""
    n, good, _, precision, weighted = precisions(fits)
    if not good or good < least_success * n:
        raise ValueError(f"only {good} of {n} chunks could be fitted")
    cov = np.linalg.inv(precision)
    return cov @ weighted, cov


@dataclass
class Waves:
    """theta, cov of the merged chunks; of each wave the chunks, those fitted, evaluations and the estimate after it."""

    theta: np.ndarray
    cov: np.ndarray
    waves: list
    fits: DataFrame
    failed: DataFrame


def wave_fits(df: DataFrame, model, x, y: str, chunk: Column, p0, waves: int = 4, again: int = 2, sigma: str | None = None, nan_policy: str = "omit", least_success: float = 0.5) -> Waves:
    """Chunks fitted in waves: chunk c in wave c % waves, each wave from the estimate that the precision of all chunks
    before it gives. A chunk that fails is tried again in the next wave, from the estimate there, and in up to `again`
    waves after the last. Each wave's fits are written once; chunks that failed stay a table.

    Late waves start near their solution, so they take few evaluations; early ones should hold enough rows to
    determine the parameters. The estimate weighs every chunk once, as merge() does.
    """
    df = df.withColumn("_chunk", chunk.cast("long"))
    theta, precision, weighted, past, failed, done = np.asarray(p0, float), 0.0, 0.0, [], None, None
    for w in range(waves + again):
        part = df.filter(F.pmod("_chunk", F.lit(waves)) == w) if w < waves else df.limit(0)
        if failed is not None:
            retry = df.join(F.broadcast(failed.select(F.col("chunk_id").alias("_c"))), F.col("_chunk") == F.col("_c"), "left_semi")  # at most a row per chunk
            part = part.unionByName(retry)
        fits = written(chunk_fits(part, model, x, y, F.col("_chunk"), theta, sigma, 0, nan_policy), "wave-fits")
        n, good, nfev, p, v = precisions(fits)
        if good:
            precision, weighted = precision + p, weighted + v
            theta = np.linalg.solve(precision, weighted)
        past.append({"wave": w, "chunks": n, "fitted": good, "nfev": nfev, "theta": theta.copy()})
        own = fits.filter("success")
        done = own if done is None else done.unionByName(own)
        failed = fits.filter("not success") if good < n else None
        if failed is None and w >= waves - 1:
            break
    fitted, lost = sum(h["fitted"] for h in past), 0 if failed is None else past[-1]["chunks"] - past[-1]["fitted"]
    if not fitted or fitted < least_success * (fitted + lost):
        raise ValueError(f"only {fitted} of {fitted + lost} chunks could be fitted")
    return Waves(theta, np.linalg.inv(precision), past, done, done.limit(0) if failed is None else failed)


def failures(fits: DataFrame) -> DataFrame:
    """Chunks by error type, most frequent first."""
    return fits.filter("not success").groupBy("error_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_type")


def linear_sums(pts: DataFrame, model, theta) -> DataFrame:
    """One row of additive sums of points() at theta: adding rows of several inputs is the sum over their union."""
    return pts.agg(*normal.aggregates(normal.terms(named(model), theta)))
