"""Guards around a fit: problem checks, internal rescaling, and a chain of fallbacks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import named
from .fit import FitResult, curve_fit


def condition(df: DataFrame, columns: list) -> float:
    """Condition of the design [1, x, x^2] of one column, or of the columns of several, from sums."""
    if len(columns) == 1:
        x = F.col(columns[0]).cast("double")
        s = df.agg(*(F.sum(x**i).alias(f"s{i}") for i in range(5))).first()
        a = np.array([[s[f"s{i + j}"] for j in range(3)] for i in range(3)], float)
    else:
        k = len(columns)
        s = df.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j)).first()
        a = np.array([[s[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    lam = np.linalg.eigvalsh(a)
    return math.sqrt(lam[-1] / lam[0]) if lam[0] > 0 else math.inf


def jacobian_sparsity(pts: DataFrame, model, theta, threshold: float = 0.0) -> list:
    """Share of each derivative's values of size at most threshold."""
    from ..functions import expr as E
    from .normal import columns

    model = named(model)
    p = dict(zip(model.params, theta))
    js = [E.to_column(g, p, columns(model)) for g in model.gradient]
    return list(pts.agg(*(F.avg(F.when(F.abs(j) <= threshold, 1.0).otherwise(0.0)).alias(str(i)) for i, j in enumerate(js))).first())


def check_problem(df: DataFrame, x: list, y: str, p0=None) -> list:
    """Warnings about condition, ranges, collinearity and the spread of starting values."""
    out = []
    c = condition(df, x)
    if c > 1e12:
        out.append(f"ill-conditioned predictors: {c:.3g}")
    r = df.agg(*(F.max(v) - F.min(v) for v in [*x, y])).first()
    out += [f"{v}: range {s:.3g}" for v, s in zip([*x, y], r) if s is not None and s > 1e6]
    if len(x) > 1:
        from .frame import collinear

        out += [f"{row.a} and {row.b} are collinear: {row.r:.3f}" for row in collinear(df, x).collect()]
    if p0 is not None:
        a = np.abs(np.asarray(p0, float))
        a = a[a > 0]
        if len(a) and a.max() / a.min() > 1e6:
            out.append("starting values differ by more than 1e6")
    return out


def fit_with_fallback(df: DataFrame, model, x, y: str, p0=None, bounds=None, seed: int = 0, **options) -> tuple:
    """(fit, what worked): plain, perturbed start, looser tolerances, inferred bounds, robust loss, in this order."""
    model = named(model)
    rng = np.random.default_rng(seed)
    base = None if p0 is None else np.asarray(p0, float)
    tried = [("plain", {})]
    if base is not None:
        tried += [(f"perturbed {i}", {"p0": base * (1 + 0.1 * rng.normal(size=len(base)))}) for i in range(3)]
    tried.append(("loose", {"ftol": 1e-7, "xtol": 1e-7, "gtol": 1e-7}))
    if bounds is None and base is not None:
        reach = 10 * np.maximum(np.abs(base), 1.0)
        tried.append(("bounded", {"bounds": (base - reach, base + reach)}))
    tried.append(("robust", {"loss": "soft_l1"}))
    error: Exception | None = None
    for name, change in tried:
        try:
            fit: FitResult = curve_fit(df, model, x, y, **{"p0": p0, "bounds": bounds, **options, **change})
            if fit.outcome.success and np.isfinite(fit.popt).all():
                return fit, name
        except (ValueError, np.linalg.LinAlgError) as e:
            error = e
    raise ValueError(f"no way of fitting worked: {error}")
