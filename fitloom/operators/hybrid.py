"""A fit in four phases for starting values that are far off: normalise, warm up, Gauss-Newton, covariance.

Parameters are put in units of their bounds or of their starting size. The warm-up is limited-memory
BFGS with guards: it is skipped where the start already explains the data, its first step is shorter
the better the start, steps are clipped, and a rise of the cost ends it at the best point seen. The
trust-region solver goes on from there. Every evaluation is one aggregate over the rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import named
from . import frame, normal, solve
from .fit import FitResult, covariance, start_values
from .precision import Normalizer


@dataclass(frozen=True)
class Settings:
    steps: int = 30
    memory: int = 6
    explained: float = 0.01  # mean squared residual over the variance of y below which there is no warm-up
    rise: float = 1.05
    clip: float = 0.1
    flat: float = 1e-6
    tolerance: float = 1e-10


PRESETS = {
    "default": Settings(),
    "aggressive": Settings(steps=60, clip=0.5, rise=1.5),
    "conservative": Settings(steps=15, clip=0.03, rise=1.01),
    # how far the warm-up's guards go: for starts near the solution, for rough ones, for published work, and none
    "strict": Settings(steps=25, clip=0.05, rise=1.05, explained=0.01),
    "relaxed": Settings(steps=50, clip=0.5, rise=1.5, explained=0.5),
    "science": Settings(steps=35, clip=0.1, rise=1.2, explained=0.05, tolerance=1e-12),
    "unguarded": Settings(steps=30, clip=1e9, rise=1e9, explained=0.0),
}


@dataclass(frozen=True)
class GroupVariance:
    """strength * rows * variance of theta over each (from, to) of parameters, added to the cost."""

    groups: tuple
    strength: float

    def terms(self, theta: np.ndarray, n: int) -> tuple:
        """(cost, gradient, Hessian)"""
        cost, g, h = 0.0, np.zeros(len(theta)), np.zeros((len(theta),) * 2)
        for a, b in self.groups:
            m = b - a
            centred = np.eye(m) - 1 / m
            d = centred @ theta[a:b]
            cost += self.strength * n * (d @ d) / m
            g[a:b] += 2 * self.strength * n * d / m
            h[a:b, a:b] += 2 * self.strength * n * centred / m
        return cost, g, h


class Scaled:
    """A problem in normalised parameters, with a penalty."""

    def __init__(self, problem, norm: Normalizer, penalty: GroupVariance | None = None):
        self.problem, self.norm, self.penalty = problem, norm, penalty

    def __call__(self, u):
        s = self.problem(self.norm.inverse(u))
        cost, g, a = s.cost, s.g, s.a
        if self.penalty is not None:
            c, dg, h = self.penalty.terms(s.theta, s.n)
            cost, g, a = cost + c, g + dg, a + h
        scale = self.norm.scale
        return replace(s, theta=np.asarray(u, float), cost=cost, g=g * scale, a=a * np.outer(scale, scale))


def direction(g: np.ndarray, pairs: list) -> np.ndarray:
    """Descent direction by the two loops of limited-memory BFGS."""
    q, alpha = g.copy(), []
    for s, y in reversed(pairs):
        a = (s @ q) / (s @ y)
        alpha.append(a)
        q -= a * y
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(pairs, reversed(alpha)):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def warm_up(problem, u: np.ndarray, lo: np.ndarray, hi: np.ndarray, c: Settings, variance: float) -> tuple:
    """(best point, evaluations, history, why it ended)"""
    state = best = problem(u)
    if not state.usable:
        raise ValueError("the model is not finite at the starting values")
    share = 2 * state.cost / max(state.n, 1) / variance if variance > 0 else 0.0
    history = [{"iteration": 0, "cost": state.cost, "g_norm": float(np.abs(state.g).max()), "theta": u.copy()}]
    if share < c.explained:
        return best.theta, 1, history, "explained"
    first, pairs, nfev = (1.0 if share > 1 else 0.5 if share > 0.1 else 0.1), [], 1
    start = state.cost
    for i in range(c.steps):
        d = direction(state.g, pairs)
        if d @ state.g >= 0:
            pairs, d = [], -state.g
        size = np.linalg.norm(d)
        if size == 0:
            return best.theta, nfev, history, "flat"
        d *= min(first, c.clip / size)
        for _ in range(8):
            trial = problem(np.clip(state.theta + d, lo, hi))
            nfev += 1
            if trial.usable and trial.cost <= state.cost + 1e-4 * (state.g @ (trial.theta - state.theta)):
                break
            d /= 4
        else:
            return best.theta, nfev, history, "no descent"
        if trial.cost > c.rise * start:
            return best.theta, nfev, history, "rise"
        s, y = trial.theta - state.theta, trial.g - state.g
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            pairs = [*pairs[-c.memory + 1 :], (s, y)]
        change = state.cost - trial.cost
        state = trial
        best = state if state.cost < best.cost else best
        history.append({"iteration": i + 1, "cost": state.cost, "g_norm": float(np.abs(state.g).max()), "theta": state.theta.copy()})
        if change < c.flat * max(state.cost, 1e-300):
            return best.theta, nfev, history, "flat"
    return best.theta, nfev, history, "steps"


def hybrid_fit(
    df: DataFrame, model, x, y: str, p0=None, bounds=None, sigma: str | None = None, absolute_sigma: bool = False, settings="default",
    penalty: GroupVariance | None = None, nan_policy: str = "raise", keep=None, resume: str | None = None, local_rows: int = normal.LOCAL_ROWS,
) -> FitResult:
    """All phases. keep(text) is handed the driver's state as JSON after each phase and solver step; resume takes such a text."""
    c = PRESETS[settings] if isinstance(settings, str) else settings
    model = named(model)
    pts = frame.points(df, frame.Roles.of(x, y, model.variables, sigma=sigma), nan_policy)
    lo, hi = model.limits() if bounds is None else (np.broadcast_to(np.asarray(b, float), len(model.params)).copy() for b in bounds)
    problem = normal.Problem(pts, model, local_rows=local_rows)
    save = lambda phase, theta: keep and keep(json.dumps({"phase": phase, "theta": [float(t) for t in theta]}))
    try:
        known = json.loads(resume) if resume else None
        theta = np.asarray(known["theta"], float) if known else start_values(model, pts, lo, hi) if p0 is None else np.asarray(p0, float)
        theta = np.clip(theta, lo, hi)
        norm = Normalizer(theta, lo, hi)
        scaled, ulo, uhi = Scaled(problem, norm, penalty), norm.forward(lo), norm.forward(hi)
        u, nfev, history = norm.forward(theta), 0, []
        if not known or known["phase"] == "start":
            variance = pts.agg(F.var_pop(F.col("w") * F.col("y"))).first()[0] or 0.0
            u, nfev, history, _ = warm_up(scaled, u, ulo, uhi, c, variance)
            save("warm", norm.inverse(u))
        step = lambda i, cost, v, info: save("warm", norm.inverse(v))
        out = solve.minimise(scaled, u, ulo, uhi, c.tolerance, c.tolerance, c.tolerance, callback=step if keep else None)
        state = problem(norm.inverse(out.theta))
        save("done", state.theta)
    finally:
        problem.close()
    past = [h | {"theta": norm.inverse(h["theta"])} for h in history]
    later = [h | {"iteration": h["iteration"] + len(past), "theta": norm.inverse(h["theta"])} for h in out.history]
    out = replace(out, theta=state.theta, state=state, nfev=out.nfev + nfev + 1, history=past + later)
    return FitResult(model, state.theta, covariance(state, absolute_sigma)[0], out, pts, absolute_sigma)
