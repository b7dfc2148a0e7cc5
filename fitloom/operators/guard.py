"""Guards on the k x k side of a fit and around it: decompositions that fall back, checks of sums that are not
finite, conjugate gradients, limits, rescaling of data, recovery, and what to say about a result."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import named
from . import frame, normal
from .fit import FitResult, curve_fit

_EPS = float(np.finfo(float).eps)

# ---- decompositions of J'J ----


def cholesky_or_eigen(a: np.ndarray, b: np.ndarray) -> tuple:
    """(x, whether by Cholesky) of a x = b for symmetric a; eigenvalues below eps of the largest are raised to it."""
    a = (a + a.T) / 2
    try:
        low = np.linalg.cholesky(a)
        x = np.linalg.solve(low.T, np.linalg.solve(low, b))
        if np.isfinite(x).all():
            return x, True
    except np.linalg.LinAlgError:
        pass
    lam, q = np.linalg.eigh(a)
    return q @ (q.T @ b / np.maximum(lam, max(_EPS * np.abs(lam).max(initial=0.0), 1e-300))), False


def robust_svd(a: np.ndarray) -> tuple:
    """(u, s, v', how): as it is, after scaling to unit size, with a small ridge, or from the eigenvalues of a'a."""
    size = float(np.abs(a[np.isfinite(a)]).max(initial=0.0)) or 1.0
    clean = np.where(np.isfinite(a), a, 0.0)
    ridge = np.eye(*a.shape) * size * 1e-12
    for how, m, back in (("plain", a, 1.0), ("scaled", clean / size, size), ("ridge", clean + ridge, 1.0)):
        try:
            u, s, v = np.linalg.svd(m, full_matrices=False)
        except np.linalg.LinAlgError:
            continue
        if all(np.isfinite(x).all() for x in (u, s, v)):
            return u, s * back, v, how
    lam, q = np.linalg.eigh(clean.T @ clean)
    s = np.sqrt(np.maximum(lam[::-1], 0))
    v = q[:, ::-1]
    return clean @ v / np.where(s > 0, s, 1.0), s, v.T, "eigen"


def guarded_state(state) -> tuple:
    """(State, issues): sums that are not finite become 0; a parameter without influence, or a condition beyond 1e12,
    gets a ridge on the diagonal of J'J."""
    issues = {"not_finite": not (np.isfinite(state.a).all() and np.isfinite(state.g).all())}
    a, g = np.nan_to_num(state.a, nan=0.0, posinf=0.0, neginf=0.0), np.nan_to_num(state.g, nan=0.0, posinf=0.0, neginf=0.0)
    lam = np.linalg.eigvalsh(a)
    top = float(lam[-1])
    issues["condition"] = math.sqrt(top / lam[0]) if lam[0] > 0 else math.inf
    issues["no_influence"] = np.flatnonzero(np.diag(a) <= _EPS * max(top, 0)).tolist()
    issues["ridge"] = issues["condition"] > 1e12
    if issues["ridge"]:
        a = a + np.eye(len(a)) * max(top, 1.0) * 1e-12
    return normal.State(state.theta, state.cost, g, a, state.n, state.bad, state.ssr), issues


def conjugate_gradients(multiply, b: np.ndarray, diagonal: np.ndarray | None = None, tol: float = 1e-10, steps: int | None = None) -> tuple:
    """(x, steps) of A x = b where multiply(v) gives A v; Jacobi preconditioner. For J'J, multiply can be one job
    (hessian_product), so that no k x k matrix is built."""
    d = np.ones_like(b) if diagonal is None else np.where(diagonal > 0, diagonal, 1.0)
    x, r = np.zeros_like(b), b.copy()
    z = r / d
    p, rz = z.copy(), r @ z
    for i in range(steps or 10 * len(b)):
        if np.linalg.norm(r) <= tol * np.linalg.norm(b):
            return x, i
        ap = multiply(p)
        curve = p @ ap
        if curve <= 0:
            return x, i
        x, r = x + rz / curve * p, r - rz / curve * ap
        z = r / d
        rz, old = r @ z, rz
        p = z + rz / old * p
    return x, steps or 10 * len(b)


def hessian_product(pts: DataFrame, model, theta, v: np.ndarray) -> np.ndarray:
    """J'J v in one aggregate of k sums: each row's derivatives along v times its derivatives."""
    js = normal.terms(named(model), theta)["j"]
    along = js[0] * float(v[0])
    for j, x in zip(js[1:], v[1:]):
        along = along + j * float(x)
    return np.array(list(pts.agg(*(F.sum(along * j).alias(str(i)) for i, j in enumerate(js))).first()), float)


def gauss_newton_step(state, floor: float = 1e-10) -> np.ndarray:
    """-(J'J)^-1 J'r with eigenvalues below floor times the largest left out."""
    lam, q = np.linalg.eigh((state.a + state.a.T) / 2)
    keep = lam > floor * max(lam[-1], 0)
    return -(q[:, keep] / lam[keep]) @ (q[:, keep].T @ state.g)


# ---- values that leave the range of doubles ----


def bounded(c: Column, top: float = 1e10) -> Column:
    """Model values kept within +-top; NaN stays."""
    return F.when(F.isnan(c), c).otherwise(F.greatest(F.least(c, F.lit(top)), F.lit(-top)))


# ---- limits and estimates ----


def limits(n: int, k: int, bounds: tuple | None = None, most_rows: int | None = None) -> dict:
    """errors and warnings about the size of a problem and its bounds. Rows only add to sums, so their number has no
    limit of its own unless most_rows names one; parameters square the sums."""
    errors, warnings = [], []
    if n < 0 or k < 0:
        errors.append("negative size")
    if most_rows is not None and n > most_rows:
        errors.append(f"{n} rows, at most {most_rows} are allowed")
    if k and n < k:
        errors.append(f"{n} points cannot determine {k} parameters")
    if 8 * k * k > 1 << 30:
        errors.append(f"{k} parameters: J'J takes {8 * k * k} bytes on the driver")
    elif k > 1000:
        warnings.append(f"{k} parameters: each step sums {k * (k + 1) // 2} products a row")
    for i, (lo, hi) in enumerate(zip(*bounds) if bounds is not None else ()):
        if not lo < hi:
            errors.append(f"parameter {i}: lower bound {lo} is not below {hi}")
        elif max(abs(x) for x in (lo, hi) if math.isfinite(x)) > 1e100 if math.isfinite(lo) or math.isfinite(hi) else False:
            warnings.append(f"parameter {i}: bound of more than 1e100")
    return {"errors": errors, "warnings": warnings}


def vandermonde_condition(df: DataFrame, x: str, k: int) -> float:
    """Condition of the polynomial features 1, u, ..., of min(k, 5) columns, u being x scaled to [0, 1], from sums."""
    m = min(k, 5)
    lo, hi, n = df.agg(F.min(x), F.max(x), F.count(x)).first()
    if n < m or lo is None or hi - lo < 1e-10:
        return math.inf
    u = (F.col(x).cast("double") - float(lo)) / float(hi - lo)
    s = df.agg(*(F.sum(F.pow(u, F.lit(i))).alias(f"s{i}") for i in range(2 * m - 1))).first()
    lam = np.linalg.eigvalsh(np.array([[s[f"s{i + j}"] for j in range(m)] for i in range(m)], float))
    return math.sqrt(lam[-1] / lam[0]) if lam[0] > 0 else math.inf


def even_sample(df: DataFrame, order: str, count: int) -> DataFrame:
    """`count` rows at even ranks by `order`, both ends included; all rows if there are no more.

    Ranks come from a range partitioning and its counts, so no task orders all rows."""
    n = df.count()
    if n <= count:
        return df
    ranks = df.sparkSession.createDataFrame([(int(i),) for i in np.linspace(0, n - 1, count).astype(int)], "_rank long")
    return frame.ranked_rows(df, [F.col(order)]).join(F.broadcast(ranks), "_rank", "left_semi").drop("_rank")


# ---- rescaling and recovery ----


def rescaled(df: DataFrame, x: str, y: str, p0=None, ratio: float = 1e6, wide: float = 1e4) -> tuple:
    """(df, p0, what was done): x and y brought to [0, 1] where their range exceeds `wide` or is tiny, bad values of y
    replaced by the mean, starting values brought within `ratio` of each other. The offsets and scales are
    returned so that results can be turned back."""
    v = {c: F.col(c).cast("double") for c in (x, y)}
    good = {c: F.when(frame.finite(e), e) for c, e in v.items()}
    r = df.agg(*(f(good[c]).alias(f"{c}_{n}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg), ("n", F.count))), F.count("*").alias("all")).first()
    done, info = [], {"applied": []}
    for name, c in (("x", x), ("y", y)):
        lo, hi, mean = r[f"{c}_lo"], r[f"{c}_hi"], r[f"{c}_mean"]
        e = v[c]
        if r[f"{c}_n"] < r["all"]:
            e = F.coalesce(good[c], F.lit(mean))
            info["applied"].append(f"{name}: {r['all'] - r[f'{c}_n']} bad values replaced")
        scale, offset = 1.0, 0.0
        span = (hi - lo) if lo is not None else 0.0
        if span > wide or 0 < span < 1 / wide:
            scale, offset = span, lo
            info["applied"].append(f"{name}: scaled to [0, 1]")
        info[f"{name}_scale"], info[f"{name}_offset"] = scale, offset
        done.append(((e - offset) / scale).alias(c))
    if p0 is not None:
        p0 = np.asarray(p0, float)
        size = np.abs(p0[p0 != 0])
        if len(size) and size.max() / size.min() > ratio:
            middle = math.exp(np.log(size).mean())
            p0 = np.where(p0 == 0, 0.0, np.sign(p0) * np.clip(np.abs(p0), middle / ratio**0.5, middle * ratio**0.5))
            info["applied"].append("starting values brought together")
    rest = [c for c in df.columns if c not in (x, y)]
    return df.select(*rest, *done), p0, info


def recover(df: DataFrame, model, x, y: str, p0, bounds=None, tries: int = 3, seed: int = 0, **options) -> tuple:
    """(fit, how) after a fit that failed: from perturbed starts of growing size, a start from the data, with bounds
    around the start, with a robust loss, and by a search of many starts inside those bounds."""
    from .search import multi_start

    model, rng, base = named(model), np.random.default_rng(seed), np.asarray(p0, float)
    around = bounds or (base - 100 * np.maximum(np.abs(base), 1), base + 100 * np.maximum(np.abs(base), 1))
    ways = [(f"perturbed {i + 1}", {"p0": base * (1 + 0.1 * 4**i * rng.normal(size=len(base)))}) for i in range(tries)]
    ways += [("start from data", {"p0": "auto"}), ("bounds", {"p0": base, "bounds": around}), ("robust loss", {"p0": base, "loss": "soft_l1"})]
    for how, change in ways:
        try:
            found = curve_fit(df, model, x, y, **{"bounds": bounds, **options, **change})
        except (ValueError, np.linalg.LinAlgError):
            continue
        if found.outcome.success and np.isfinite(found.popt).all():
            return found, how
    return multi_start(df, model, x, y, around, p0=base, seed=seed), "multi-start"


# ---- what to say about a result ----


def quality(result: FitResult, gtol: float = 1e-8) -> dict:
    """grade (excellent, good, fair, poor or failed) of a fit's convergence, and why: success, the gradient against
    gtol, whether the limit of evaluations was met, and whether the covariance exists."""
    o = result.outcome
    reasons = []
    if not np.isfinite(result.popt).all() or not math.isfinite(o.state.cost):
        return {"grade": "failed", "reasons": ["parameters or cost are not finite"]}
    if not o.success:
        reasons.append(o.message)
    if o.optimality > 1e3 * gtol * max(1.0, o.state.cost):
        reasons.append(f"gradient {o.optimality:.3g}")
    if not np.isfinite(result.pcov).all():
        reasons.append("the covariance is infinite")
    grade = "poor" if not o.success else ("excellent", "good", "fair")[min(len(reasons), 2)]
    return {"grade": grade, "reasons": reasons}


def explain(result: FitResult, gtol: float = 1e-10, max_nfev: int | None = None) -> dict:
    """Reasons why a fit fell short, and what to try."""
    o, reasons, advice = result.outcome, [], []

    def say(reason: str, *more: str) -> None:
        reasons.append(reason)
        advice.extend(x for x in more if x not in advice)

    if o.optimality > gtol:
        say(f"the gradient is {o.optimality:.3g}, over {gtol:.3g}", f"loosen gtol to {10 * gtol:.3g}", "start nearer to the solution")
    if o.nfev >= (max_nfev or 100 * len(result.popt)):
        say(f"{o.nfev} evaluations, the limit", f"allow {2 * o.nfev} evaluations", "start nearer to the solution")
    if not np.isfinite(result.popt).all():
        say("parameters are not finite", "set bounds", "bring parameters to similar sizes")
    if not math.isfinite(o.state.cost):
        say("the cost is not finite", "look for values outside the model's domain", "filter rows that are not finite")
    if o.status == -1:
        say("a step could not be evaluated", "set bounds", "guard the model against overflow")
    return {"reasons": reasons, "advice": advice}


def failed_message(error: Exception, p0=None) -> dict:
    """Reasons and advice for a fit that raised."""
    text = str(error)
    table = (
        ("null, NaN or infinite", "rows are not finite", 'use nan_policy="omit" or "mean"'),
        ("not positive", "sigma must be positive", "drop rows whose sigma is 0 or less"),
        ("not finite at the starting values", "the model is not finite at the start", f"choose another start than {p0}"),
        ("cannot determine", "there are fewer points than parameters", "add points or fix parameters"),
        ("below its upper", "bounds cross", "swap or widen the bounds"),
    )
    found = [(r, a) for mark, r, a in table if mark in text]
    return {"reasons": [r for r, _ in found] or [text], "advice": [a for _, a in found]}
