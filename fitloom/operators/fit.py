"""curve_fit on DataFrames: validation, starting values, the loop, covariance and the result."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import Model, named, summary
from ..functions.special import t_quantile
from . import frame, normal, precision, solve
from .storage import Log


def covariance(state, absolute: bool = False) -> tuple:
    """(covariance, rank): pseudo-inverse of J'J, times SSR / (n - k) unless sigma is absolute."""
    k = len(state.theta)
    if isinstance(state, normal.TriangleState):
        inverse, rank = state.inverse()
    else:
        d = np.sqrt(np.maximum(np.diag(state.a), 0))
        d = np.where(d > 0, d, 1.0)
        lam, q = np.linalg.eigh(state.a / np.outer(d, d))
        keep = lam > np.finfo(float).eps * max(state.n, k) * max(lam[-1], 0)
        inverse = (q[:, keep] / lam[keep]) @ q[:, keep].T / np.outer(d, d)
        rank = int(keep.sum())
    if rank < k or (not absolute and state.n <= k):
        return np.full((k, k), math.inf), rank
    return inverse * (1.0 if absolute else state.ssr / (state.n - k)), rank


@dataclass
class FitResult:
    """Unpacks as (popt, pcov). Statistics are of unweighted residuals y - f, from one aggregate."""

    model: Model
    popt: np.ndarray
    pcov: np.ndarray
    outcome: solve.Outcome
    points: DataFrame
    absolute: bool = False
    notes: list = field(default_factory=list)

    def __iter__(self):
        return iter((self.popt, self.pcov))

    def full(self) -> tuple:
        """(popt, pcov, info, message, status): info holds nfev, the cost and the points with their residuals."""
        o = self.outcome
        info = {"nfev": o.nfev, "nit": o.nit, "cost": o.state.cost, "gradient": o.state.g, "fvec": self.points.withColumn("residual", normal.residual_column(self.model, self.popt))}
        return self.popt, self.pcov, info, o.message, o.status

    def evaluated(self) -> tuple:
        """(popt, pcov, points with y_hat and residual)."""
        f = self.model.column(self.popt, normal.columns(self.model))
        return self.popt, self.pcov, self.points.withColumn("y_hat", f).withColumn("residual", F.col("y") - F.col("y_hat"))

    @property
    def params(self) -> dict:
        return dict(zip(self.model.params, self.popt.tolist()))

    @property
    def stderr(self) -> dict:
        return dict(zip(self.model.params, np.sqrt(np.maximum(np.diag(self.pcov), 0)).tolist()))

    def stats(self) -> dict:
        k = len(self.popt)
        r = normal.residual_column(self.model, self.popt)
        row = self.points.agg(
            F.count("*").alias("n"), F.sum(r * r).alias("rss"), F.sum(F.abs(r)).alias("abs"),
            (F.var_pop("y") * F.count("*")).alias("tss"), F.sum((F.col("w") * r) ** 2).alias("chi2"),
        ).first()
        return statistics(row.n, k, row.rss, row["abs"], row.tss, row.chi2)

    def intervals(self, alpha: float = 0.05) -> DataFrame:
        """param, value, lower, upper, alpha."""
        t = t_quantile(1 - alpha / 2, self.outcome.state.n - len(self.popt))
        rows = [(p, v, v - t * s, v + t * s, alpha) for (p, v), s in zip(self.params.items(), self.stderr.values())]
        return self.points.sparkSession.createDataFrame(rows, "param string, value double, lower double, upper double, alpha double")

    def predict(self, alpha: float = 0.05, exact: bool = False) -> DataFrame:
        """Each point with y_hat, residual, the confidence band of the mean and a prediction interval.

        The prediction interval has constant width s sqrt(1 + tr(C)/k), or with exact the width of its point.
        """
        k = len(self.popt)
        state = self.outcome.state
        dof = state.n - k
        t = t_quantile(1 - alpha / 2, dof)
        s2 = state.ssr / dof if dof > 0 else math.nan
        cols = normal.columns(self.model)
        f, g = self.model.column(self.popt, cols), self.model.slopes(self.popt, cols)
        var = F.lit(0.0)
        for i in range(k):
            for j in range(k):
                var = var + g[i] * g[j] * F.lit(float(self.pcov[i, j]))
        band = t * F.sqrt(F.greatest(var, F.lit(0.0)))
        wide = t * F.sqrt(s2 + F.greatest(var, F.lit(0.0))) if exact else F.lit(t * math.sqrt(s2 * (1 + float(np.trace(self.pcov)) / k)) if s2 >= 0 else math.nan)
        return (
            self.points.withColumn("y_hat", f)
            .withColumn("residual", F.col("y") - F.col("y_hat"))
            .withColumn("lower", F.col("y_hat") - band)
            .withColumn("upper", F.col("y_hat") + band)
            .withColumn("pred_lower", F.col("y_hat") - wide)
            .withColumn("pred_upper", F.col("y_hat") + wide)
        )

    def residual_histogram(self, bins: int = 30) -> DataFrame:
        """bin, low, n of the residuals."""
        r = self.points.select(normal.residual_column(self.model, self.popt).alias("r"))
        lo, hi = r.agg(F.min("r"), F.max("r")).first()
        step = (hi - lo) / bins or 1.0
        b = F.least(F.floor((F.col("r") - lo) / step), F.lit(bins - 1)).cast("int")
        return r.groupBy(b.alias("bin")).agg(F.count("*").alias("n")).withColumn("low", lo + F.col("bin") * step)

    def history(self) -> DataFrame:
        rows = [(h["iteration"], float(h["cost"]), float(h["g_norm"]), h["theta"].tolist()) for h in self.outcome.history]
        return self.points.sparkSession.createDataFrame(rows, "iteration int, cost double, g_norm double, params array<double>")

    def to_df(self, fit_id: str = "fit") -> DataFrame:
        o = self.outcome
        row = (fit_id, o.state.n, len(self.popt), o.status, o.success, o.message, float(o.state.cost), o.nfev, o.nit, o.optimality, self.params, self.stderr, [list(map(float, r)) for r in self.pcov])
        return self.points.sparkSession.createDataFrame(
            [row],
            "fit_id string, n long, k int, status int, success boolean, message string, cost double, nfev int, nit int, optimality double, "
            "params map<string,double>, stderr map<string,double>, cov array<array<double>>",
        )


def statistics(n: int, k: int, rss: float, abs_sum: float, tss: float, chi2: float) -> dict:
    """r2, adj_r2, rmse, mae, aic, bic, chi2; None where undefined."""
    r2 = 1 - rss / tss if tss and tss > 0 else None
    return {
        "n": n,
        "r2": r2,
        "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k - 1) if r2 is not None and n > k + 1 else None,
        "rmse": math.sqrt(rss / n) if n else None,
        "mae": abs_sum / n if n else None,
        "aic": 2 * k + n * math.log(rss / n) if rss > 0 else None,
        "bic": k * math.log(n) + n * math.log(rss / n) if rss > 0 else None,
        "chi2": chi2,
    }


def start_values(model: Model, pts: DataFrame, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The model's rule; without one the middle of finite bounds, a step off a single bound, else 1."""
    if model.start is not None:
        return np.asarray(model.start(frame.curve(pts, model.variables[0])), float)
    out = np.ones(len(model.params))
    both, low, high = np.isfinite(lo) & np.isfinite(hi), np.isfinite(lo) & ~np.isfinite(hi), ~np.isfinite(lo) & np.isfinite(hi)
    out[both], out[low], out[high] = (lo[both] + hi[both]) / 2, lo[low] + 1, hi[high] - 1
    return out


def linear_fit(df: DataFrame, model: Model, roles: frame.Roles, nan_policy: str, absolute: bool) -> FitResult:
    """A model that is linear in its parameters, without bounds: sums at 0, which also count what is not finite, and
    sums at the solution. No start is needed, and rows are neither kept nor fetched."""
    pts = frame.points(df, roles, nan_policy if roles.sigma or nan_policy != "raise" else "propagate")

    def problem(theta):
        state = normal.unpacked(pts.agg(*normal.aggregates(normal.terms(model, theta))).first(), theta)
        if state.bad and nan_policy != "propagate":
            raise ValueError(f"{state.bad} rows hold null, NaN or infinite values")
        if state.n < len(theta):
            raise ValueError(f"{state.n} points cannot determine {len(theta)} parameters")
        return state

    out = solve.minimise(problem, np.zeros(len(model.params)), linear=True)
    return FitResult(model, out.theta, covariance(out.state, absolute)[0], out, pts, absolute)


def curve_fit(
    df: DataFrame,
    model,
    x,
    y: str,
    sigma: str | None = None,
    p0=None,
    bounds=None,
    loss="linear",
    f_scale: float = 1.0,
    absolute_sigma: bool = False,
    nan_policy: str = "raise",
    mask: str | None = None,
    order: str | None = None,
    ftol: float = 1e-10,
    xtol: float = 1e-10,
    gtol: float = 1e-10,
    max_nfev: int | None = None,
    callback=None,
    local_rows: int = normal.LOCAL_ROWS,
    auto_bounds: bool = False,
    full_output: bool = False,
    return_eval: bool = False,
    timeit: bool = False,
    solver: str = "normal",
    log: str | None = None,
    stability: str | None = None,
    multistart: int = 0,
    fallback: bool = False,
):
    """A FitResult, or with full_output its full(), with return_eval its evaluated(); timeit adds the seconds the
    fit took as the last of those. stability ("check" or "auto"), multistart (a number of starts) and fallback as in
    robust.dispatched(); what was found and done is in the result's notes. Other options as in fitted()."""
    began = time.perf_counter()
    options = dict(
        sigma=sigma, p0=p0, bounds=bounds, loss=loss, f_scale=f_scale, absolute_sigma=absolute_sigma, nan_policy=nan_policy, mask=mask, order=order, ftol=ftol, xtol=xtol, gtol=gtol,
        max_nfev=max_nfev, callback=callback, local_rows=local_rows, auto_bounds=auto_bounds, solver=solver, log=log,
    )
    if stability not in (None, "check", "auto"):
        raise ValueError(f"unknown stability {stability}")
    if stability or multistart or fallback:
        from .robust import dispatched

        found = dispatched(df, model, x, y, stability, multistart, fallback, options)
    else:
        found = fitted(df, model, x, y, **options)
    if not (full_output or return_eval or timeit):
        return found
    out = found.full() if full_output else found.evaluated() if return_eval else tuple(found)
    return (*out, time.perf_counter() - began) if timeit else out


def fitted(
    df: DataFrame, model, x, y: str, sigma=None, p0=None, bounds=None, loss="linear", f_scale: float = 1.0, absolute_sigma: bool = False, nan_policy: str = "raise", mask=None, order=None,
    ftol: float = 1e-10, xtol: float = 1e-10, gtol: float = 1e-10, max_nfev=None, callback=None, local_rows: int = normal.LOCAL_ROWS, auto_bounds: bool = False, solver: str = "normal", log: str | None = None, guarded: bool = False,
) -> FitResult:
    """Fit `model` (a Model, a numeric model, a registered name or a formula) to columns of df.

    bounds: (lower, upper) numbers or vectors; default the model's own; auto_bounds puts bounds inferred
    from the data where none are given. p0: numbers, None for the model's starting rule, or "auto" for
    that rule or, without one, values by position from the data. nan_policy: raise, omit, propagate or
    mean. local_rows: up to so many rows are fetched once and summed on the driver; more stay where
    they are. solver: "normal" steps from J'J; "qr" from a tree of triangles of J, which keeps twice the digits at
    one more pass per step; "auto" takes qr once the condition of J is beyond 1e6.
    log: a shared folder that keeps every evaluation; a fit that was stopped goes on from it. guarded: the model's
    values are kept within 1e10 and its sums are guarded (robust.Guarded).
    """
    if solver not in ("normal", "qr", "auto"):
        raise ValueError(f"unknown solver {solver}")
    model = named(model)
    roles = frame.Roles.of(x, y, model.variables, sigma=sigma, mask=mask, order=order)
    free = bounds is None and not np.isfinite(np.concatenate(model.limits())).any()
    if solver == "normal" and log is None and not guarded and model.linear and loss == "linear" and free and p0 is None and callback is None and not auto_bounds and model.expr is not None and len(model.params) <= normal.SQL_WIDTH:
        return linear_fit(df, model, roles, nan_policy, absolute_sigma)
    pts = frame.points(df, roles, nan_policy)
    lo, hi = model.limits() if bounds is None else (np.broadcast_to(np.asarray(b, float), len(model.params)).copy() for b in bounds)
    whole = model
    if guarded:
        from .robust import Guarded, bounded_model

        model = bounded_model(model) if model.expr is not None else model
    problem = normal.Problem(pts, model, loss, f_scale, local_rows, solver)
    problem = Guarded(problem) if guarded else problem
    problem = problem if log is None else normal.Logged(problem, Log(df.sparkSession, log))
    try:
        curve = frame.curve(pts, model.variables[0])
        if isinstance(p0, str) and p0 == "auto" and model.start is None:
            theta = np.asarray(precision.generic_start(summary(curve), len(model.params)), float)
        else:
            theta = start_values(model, pts, lo, hi) if p0 is None or isinstance(p0, str) else np.asarray(p0, float)
        if len(theta) != len(model.params):
            raise ValueError(f"{len(theta)} starting values for {len(model.params)} parameters")
        if auto_bounds:
            lo, hi = precision.merge_bounds((lo, hi), precision.infer_bounds(theta, summary(curve)))
        theta = np.clip(theta, lo, hi)
        out = solve.minimise(problem, theta, lo, hi, ftol, xtol, gtol, max_nfev, callback, loss == "linear" and whole.linear and not guarded)
    finally:
        problem.close()
    if out.state.n < len(theta):
        raise ValueError(f"{out.state.n} points cannot determine {len(theta)} parameters")
    pcov, _ = covariance(out.state, absolute_sigma)
    notes = [f"{len(problem.issues)} guarded evaluations"] if guarded and log is None and problem.issues else []
    return FitResult(whole, out.theta, pcov, out, pts, absolute_sigma, notes)
