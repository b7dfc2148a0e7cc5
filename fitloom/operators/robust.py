"""What curve_fit does for problems that a plain fit fails on: guards inside the solver, rescaled data whose results are
turned back, several starts, and a chain of other ways."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.models import Model, named
from . import fit as fits
from . import frame, guard, normal, stability

TOP = 1e10


class Guarded:
    """A Problem whose sums pass through guard.guarded_state: a ridge where J'J is beyond 1e12 or a parameter has no influence,
    0 for sums that are not finite. `issues` keeps what was met."""

    def __init__(self, problem):
        self.problem, self.issues = problem, []

    def close(self) -> None:
        self.problem.close()

    def __call__(self, theta) -> normal.State:
        state = self.problem(theta)
        if state.bad or not np.isfinite(state.cost):
            return state
        fixed, issues = guard.guarded_state(state)
        if issues["ridge"] or issues["not_finite"] or issues["no_influence"]:
            self.issues.append(issues)
            return fixed
        return state


def bounded_model(model: Model, top: float = TOP) -> Model:
    """The model with values kept within +-top; where they would leave it, derivatives are 0."""
    if model.expr is None:
        raise ValueError("values of a numeric model are bounded by its own function")
    return replace(model, expr=E.clip(model.expr, -top, top), jac=None)


# ---- rescaled data ----


def turned(model: Model, theta: np.ndarray, x: tuple, y: tuple, tries: int = 4000) -> np.ndarray:
    """Parameters in original units of those found on (x - x[0]) / x[1] and (y - y[0]) / y[1]: those with the same values over
    the data's range. Units move from one to the other in steps, each solved from where the last two lead; steps that
    fail are halved, others grow. ValueError where the model has no such parameters."""
    u = np.linspace(0, 1, max(64, 8 * len(theta)))
    v = model.variables[0]
    base = model.values(theta, {v: u})

    def between(unit: tuple, t: float) -> tuple:
        """(offset, size) on the way; offset over size never exceeds what it is at the end."""
        size = unit[1] ** t
        return unit[0] * (t if abs(unit[1] - 1) < 1e-9 else (size - 1) / (unit[1] - 1)), size

    def solved(t: float, guess: np.ndarray) -> np.ndarray | None:
        (ox, sx), (oy, sy), out = between(x, t), between(y, t), guess
        at, goal = {v: ox + sx * u}, oy + sy * base
        for _ in range(30):
            gap, j = goal - model.values(out, at), model.jacobian(out, at)
            if not (np.isfinite(gap).all() and np.isfinite(j).all()):
                return None
            d = np.linalg.norm(j, axis=0)
            step = np.linalg.lstsq(j / np.where(d > 0, d, 1.0), gap, rcond=1e-14)[0] / np.where(d > 0, d, 1.0)
            out = out + step
            if (np.abs(step) <= 1e-13 * np.maximum(np.abs(out), 1e-300)).all():
                break
        gap = np.abs(goal - model.values(out, at)).max()
        return out if gap <= 1e-6 * max(np.ptp(goal), 1e-300) else None

    done, before, now, h = 0.0, None, np.asarray(theta, float), 0.02 / max(1.0, abs(x[0]), abs(np.log(x[1])), abs(np.log(y[1])))
    with np.errstate(all="ignore"):
        for _ in range(tries):
            t = min(1.0, done + h)
            guess = now if before is None else now + (now - before[1]) * (t - done) / (done - before[0])
            found = solved(t, guess)
            if found is None:
                h /= 2
                if done + h == done:
                    break
                continue
            before, now, done, h = (done, now), found, t, 2 * h
            if done == 1.0:
                return now
    raise ValueError("results of rescaled data cannot be turned back")


def rescaled_fit(df: DataFrame, model, x: str, y: str, p0=None, sigma: str | None = None, nan_policy: str = "raise", **options):
    """A FitResult in original units, fitted with x in [0, 1] and y in [-1, 1]. Parameters are turned back by turned(), their
    covariance and the sums by its derivative. p0: values in original units, or None or "auto" for a start from the
    rescaled data. Bounds belong to original units and are not taken."""
    model = named(model)
    if model.expr is None or len(model.variables) > 1:
        raise ValueError("data are rescaled for formulas of one variable")
    if options.pop("bounds", None) is not None:
        raise ValueError("rescaled fits take no bounds")
    free = replace(model, bounds=None)
    r = df.agg(*(f(F.when(frame.finite(F.col(c).cast("double")), F.col(c).cast("double"))) for c in (x, y) for f in (F.min, F.max))).first()
    if None in tuple(r):
        raise ValueError("there are no finite rows")
    (ox, sx), (oy, sy) = (float(r[0]), float(r[1] - r[0]) or 1.0), (0.0, max(abs(r[2]), abs(r[3])) or 1.0)  # y keeps its zero, which few models can move
    scaled = df.withColumn("_u", (F.col(x).cast("double") - ox) / sx).withColumn("_v", (F.col(y).cast("double") - oy) / sy)
    if sigma is not None:
        scaled = scaled.withColumn("_s", F.col(sigma).cast("double") / sy)
    start = "auto" if p0 is None or isinstance(p0, str) else turned(free, np.asarray(p0, float), (-ox / sx, 1 / sx), (-oy / sy, 1 / sy))
    found = fits.fitted(scaled, free, "_u", "_v", sigma=None if sigma is None else "_s", p0=start, nan_policy=nan_policy, **options)
    theta = turned(free, found.popt, (ox, sx), (oy, sy))
    u = np.linspace(0, 1, 64)
    v = model.variables[0]
    outer, inner = model.jacobian(theta, {v: ox + sx * u}), sy * model.jacobian(found.popt, {v: u})
    d = np.linalg.norm(outer, axis=0)
    move = np.linalg.lstsq(outer / np.where(d > 0, d, 1.0), inner, rcond=1e-14)[0] / np.where(d > 0, d, 1.0)[:, None]
    back = np.linalg.inv(move)
    s, size = found.outcome.state, sy * sy if sigma is None else 1.0
    state = normal.State(theta, s.cost * size, back.T @ s.g * size, back.T @ s.a @ back * size, s.n, s.bad, s.ssr * size)
    absolute = options.get("absolute_sigma", False)
    pts = frame.points(df, frame.Roles.of(x, y, model.variables, sigma=sigma), "omit" if nan_policy == "raise" else nan_policy)
    out = replace(found.outcome, theta=theta, state=state)
    return fits.FitResult(model, theta, move @ found.pcov @ move.T, out, pts, absolute, [*found.notes, f"x scaled by {sx:g} from {ox:g}, y by {sy:g}"])


# ---- one call ----


def dispatched(df: DataFrame, model, x, y: str, stability_mode: str | None, multistart: int, fallback: bool, options: dict):
    """curve_fit with stability, multistart or fallback.

    stability "check": limits and the problem's condition are looked at first; what is wrong raises, what is doubtful is
    noted. "auto": also, data of a huge offset or range are rescaled (formulas of one variable, without bounds), values
    are kept within 1e10 and sums are guarded. multistart: the best of so many starts inside finite bounds, and p0.
    fallback: a fit that raises or does not converge is tried in the ways of stability.fit_with_fallback and guard.recover.
    """
    model, notes = named(model), []
    bounds, p0 = options.get("bounds"), options.get("p0")
    columns = [x] if isinstance(x, str) else list(x)
    if stability_mode:
        n, finite = df.agg(F.count("*"), F.count(F.when(frame.finite(F.col(y).cast("double")), 1))).first()
        k = len(model.params)
        wide = None if bounds is None else tuple(np.broadcast_to(np.asarray(b, float), k) for b in bounds)
        found = guard.limits(n, k, wide)
        if found["errors"]:
            raise ValueError("; ".join(found["errors"]))
        notes += found["warnings"]
        rows = df.dropna(subset=[*columns, y]) if finite < n else df
        notes += stability.check_problem(rows, columns, y, None if isinstance(p0, str) else p0)
    rescale = stability_mode == "auto" and bounds is None and len(columns) == 1 and model.expr is not None and any("ill-conditioned" in t or t.startswith(f"{columns[0]}: range") for t in notes)
    plain = {k: v for k, v in options.items() if k not in ("bounds",) or v is not None}

    def one():
        if multistart:
            from .search import multi_start

            if bounds is None:
                raise ValueError("several starts need finite bounds")
            keep = {k: plain[k] for k in ("sigma", "nan_policy", "local_rows", "log") if k in plain}
            return multi_start(df, model, x, y, bounds, n_starts=multistart, p0=None if isinstance(p0, str) else p0, which=options.get("loss", "linear"), f_scale=options.get("f_scale", 1.0), **keep)
        if rescale:
            keep = {k: v for k, v in plain.items() if k not in ("mask", "order", "auto_bounds", "callback")}
            return rescaled_fit(df, model, columns[0], y, **keep)
        out = fits.fitted(df, model, x, y, guarded=stability_mode == "auto", **plain)
        if stability_mode == "auto" and model.expr is not None:
            f = F.abs(model.column(out.popt, normal.columns(model)))
            if out.points.agg(F.count(F.when(F.isnan(f) | (f >= TOP), 1))).first()[0]:
                raise ValueError(f"the fit ended where the model's values leave {TOP:g}")
        return out

    try:
        out = one()
        if out.outcome.success or not fallback:
            return replace(out, notes=[*notes, *out.notes])
        notes.append(out.outcome.message)
    except (ValueError, np.linalg.LinAlgError) as e:
        if not fallback:
            raise
        notes.append(str(e))
    keep = {k: v for k, v in plain.items() if k not in ("p0", "bounds", "loss", "auto_bounds", "log")}
    try:
        out, how = stability.fit_with_fallback(df, model, x, y, None if isinstance(p0, str) else p0, bounds, **keep)
    except ValueError:
        if p0 is None or isinstance(p0, str):
            raise
        out, how = guard.recover(df, model, x, y, p0, bounds, **{k: v for k, v in keep.items() if k in ("sigma", "nan_policy", "local_rows", "ftol", "xtol", "gtol")})
    return replace(out, notes=[*notes, f"fallback: {how}"])

