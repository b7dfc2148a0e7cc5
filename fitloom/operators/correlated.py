"""Fits of responses with correlated errors: a covariance matrix per block of rows, blocks independent; and
autoregressive errors along series of any length.

Each evaluation whitens a block's residuals and derivatives by the Cholesky factor of its covariance
inside the task that holds the block, and adds up sums only. A block and its matrix must fit a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import named
from . import frame, normal, solve
from .fit import FitResult, covariance, start_values


class BlockProblem:
    """rows: points with the columns block, ord and cov (the row's row of its block's matrix, columns by ord)."""

    def __init__(self, rows: DataFrame, model):
        self.rows, self.model, self.calls = rows.persist(), model, 0

    def close(self) -> None:
        self.rows.unpersist()

    def __call__(self, theta) -> normal.State:
        self.calls += 1
        theta, model = np.asarray(theta, float), self.model
        k = len(theta)

        def sums(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("ord")
            v = {x: pdf[f"v_{x}"].to_numpy(float) for x in model.variables}
            root = np.linalg.cholesky(np.array([np.asarray(c, float) for c in pdf["cov"]]))
            with np.errstate(all="ignore"):
                m = np.column_stack([model.jacobian(theta, v), model.values(theta, v) - pdf["y"].to_numpy(float)])
            ok = np.isfinite(m).all()
            m = np.linalg.solve(root, np.nan_to_num(m))
            total = m.T @ m
            s = np.concatenate([[len(pdf), 0 if ok else len(pdf)], total.ravel()])
            return pd.DataFrame({"i": np.arange(len(s), dtype=np.int32), "s": s})

        t = np.zeros(2 + (k + 1) ** 2)
        for r in self.rows.groupBy("block").applyInPandas(sums, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
            t[r.i] = r.s
        m = t[2:].reshape(k + 1, k + 1)
        return normal.State(theta, float(m[k, k] / 2), m[:k, k], m[:k, :k], int(t[0]), int(t[1]), float(m[k, k]))


def correlated_fit(df: DataFrame, model, x, y: str, block: str, cov: str, order: str, p0=None, bounds=None, absolute_sigma: bool = True, nan_policy: str = "raise") -> FitResult:
    """Generalised least squares. cov: array column, each row's row of its block's covariance matrix, in the order of `order`."""
    model = named(model)
    kept = df.withColumn("block", F.col(block)).withColumn("cov", F.col(cov).cast("array<double>"))
    rows = frame.points(kept, frame.Roles.of(x, y, model.variables, order=order), nan_policy, extra=("block", "cov"))
    lo, hi = model.limits() if bounds is None else (np.broadcast_to(np.asarray(b, float), len(model.params)).copy() for b in bounds)
    problem = BlockProblem(rows, model)
    try:
        theta = start_values(model, rows, lo, hi) if p0 is None else np.asarray(p0, float)
        out = solve.minimise(problem, np.clip(theta, lo, hi), lo, hi)
    finally:
        problem.close()
    return FitResult(model, out.theta, covariance(out.state, absolute_sigma)[0], out, rows, absolute_sigma)


def group_weighted_loss(df: DataFrame, model, x, y: str, theta, key: str, weights: dict) -> float:
    """Sum of w r^2 over sum of w, w by the value of `key`; weights: a number per value, others weigh 0."""
    model = named(model)
    pts = frame.points(df, frame.Roles.of(x, y, model.variables), "omit", extra=(key,))
    kind = dict(pts.dtypes)[key]
    table = df.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], f"`_k` {kind}, `_w` double")
    r = normal.residual_column(model, theta)
    got = pts.join(F.broadcast(table), F.col(key) == F.col("_k")).agg(F.sum(F.col("_w") * r * r).alias("s"), F.sum("_w").alias("w")).first()
    return float(got.s / got.w) if got.w else float("nan")


# ---- autoregressive errors ----


def start_factor(phi: np.ndarray) -> np.ndarray:
    """Whitening of the first p errors of a stationary series with unit innovations: inverse Cholesky factor of their
    covariance, from the Yule-Walker equations."""
    p = len(phi)
    a = np.zeros((p + 1, p + 1))
    for i in range(p + 1):  # gamma_i - sum phi_j gamma_|i-j| = [i = 0]
        a[i, i] += 1
        for j, f in enumerate(phi, 1):
            a[i, abs(i - j)] -= f
    gamma = np.linalg.solve(a, np.eye(p + 1)[0])
    low = np.linalg.cholesky(np.array([[gamma[abs(i - j)] for j in range(p)] for i in range(p)]))
    return np.linalg.inv(low)


class SeriesProblem:
    """rows: points with lagged copies of their variables and y; the precision of the errors is banded, so a whitened
    residual is a combination of a row's residual and those of the p rows before it."""

    def __init__(self, rows: DataFrame, model, phi):
        self.rows, self.model, self.calls, self.phi = rows.persist(), model, 0, np.asarray(phi, float)

    def close(self) -> None:
        self.rows.unpersist()

    def shares(self) -> list:
        """The factor of the row itself and of each row before it; by `_t` for the first p rows of a series."""
        p, first = len(self.phi), start_factor(self.phi)
        out = []
        for i in range(p + 1):
            c = F.when(F.col("_t") >= p, F.lit(1.0 if i == 0 else -float(self.phi[i - 1])))
            for t in range(p):
                c = c.when(F.col("_t") == t, F.lit(float(first[t, t - i]) if i <= t else 0.0))
            out.append(c)
        return out

    def combined(self, make) -> object:
        """The combination of make(suffix) over the row ("") and those before it ("_1", ...)."""
        total = None
        for i, c in enumerate(self.shares()):
            part = F.when(F.col("_t") >= i, c * make(f"_{i}" if i else "")).otherwise(F.lit(0.0)) if i else c * make("")
            total = part if total is None else total + part
        return total

    def __call__(self, theta) -> normal.State:
        self.calls += 1
        model, theta = self.model, np.asarray(theta, float)
        cols = lambda s: {v: f"v_{v}{s}" for v in model.variables}
        r = self.combined(lambda s: model.column(theta, cols(s)) - F.col(f"y{s}"))
        js = [self.combined(lambda s, i=i: model.slopes(theta, cols(s))[i]) for i in range(len(theta))]
        names = ["_r", *(f"_j{i}" for i in range(len(js)))]
        rows = self.rows.select(*(c.alias(n) for c, n in zip([r, *js], names)))
        r, js = F.col("_r"), [F.col(n) for n in names[1:]]
        got = rows.agg(*normal.aggregates({"r": r, "cost": 0.5 * r * r, "rho1": F.lit(1.0), "hess": F.lit(1.0), "j": js})).first()
        return normal.unpacked(got, theta)


def series_coefficients(rows: DataFrame, model, theta, p: int) -> np.ndarray:
    """Autoregressive coefficients of the residuals at theta, by Yule-Walker, from one aggregate over lagged rows."""
    e = [model.column(theta, {v: f"v_{v}{s}" for v in model.variables}) - F.col(f"y{s}") for s in ("", *(f"_{i}" for i in range(1, p + 1)))]
    got = rows.agg(*(F.sum(e[0] * x).alias(str(i)) for i, x in enumerate(e))).first()
    r = np.array([got[str(i)] for i in range(p + 1)], float)
    if not r[0] > 0:
        return np.zeros(p)
    return np.linalg.solve(np.array([[r[abs(i - j)] for j in range(p)] for i in range(p)]), r[1:])


def series_fit(
    df: DataFrame, model, x, y: str, order: list, phi=None, lags: int = 1, keys: tuple = (), p0=None, bounds=None, rounds: int = 4, nan_policy: str = "omit", block: int = 100_000,
) -> tuple:
    """(fit, phi): generalised least squares where errors follow e_t = phi_1 e_(t-1) + ... + innovation along `order`, in
    each series of `keys`. phi: given, or estimated from the residuals and refitted, `rounds` times.

    A series may be longer than any task: its rows are cut into blocks with a halo of `lags` rows (frame.lagged). The
    first rows of a series are whitened by the stationary covariance, so no row is lost. Ties in `order` leave the order of
    those rows open: give columns that settle it. Rows that are not finite are left out before lags are taken.
    """
    model = named(model)
    if model.expr is None or len(model.params) > normal.SQL_WIDTH:
        raise ValueError("errors along series need a formula of few parameters")
    roles = frame.Roles.of(x, y, model.variables, keys=tuple(keys))
    alias = [f"_o{i}" for i in range(len(order))]
    for a, c in zip(alias, order):
        df = df.withColumn(a, F.col(c) if isinstance(c, str) else c)
    pts = frame.points(df, roles, nan_policy, extra=tuple(alias)).drop("ord", "w")
    p = len(phi) if phi is not None else lags
    rows = frame.lagged(pts, [F.col(a) for a in alias], [*(f"v_{v}" for v in model.variables), "y"], p, tuple(keys), block).withColumn("w", F.lit(1.0)).withColumn("ord", F.col(alias[0]))
    lo, hi = model.limits() if bounds is None else (np.broadcast_to(np.asarray(b, float), len(model.params)).copy() for b in bounds)
    free = not np.isfinite(np.concatenate([lo, hi])).any()
    theta = np.zeros(len(model.params)) if p0 is None and model.linear else start_values(model, rows, lo, hi) if p0 is None else np.asarray(p0, float)
    found = np.zeros(p) if phi is None else np.asarray(phi, float)
    problem = SeriesProblem(rows, model, found)
    try:
        for i in range(rounds + 1 if phi is None else 1):
            out = solve.minimise(problem, np.clip(theta, lo, hi), None if free else lo, None if free else hi, linear=model.linear)
            theta = out.theta
            if phi is not None or i == rounds:
                break
            problem.phi = series_coefficients(problem.rows, model, theta, p)
    finally:
        problem.close()
    return FitResult(model, theta, covariance(out.state)[0], out, rows), problem.phi
