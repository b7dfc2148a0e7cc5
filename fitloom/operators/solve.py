"""Trust-region least squares on k-vectors. The data are seen only through Problem: cost, J'r and J'J.

Variables are scaled by the columns' norms; inside bounds also by the distance to the bound that the
gradient points to. The step solves the scaled quadratic model within the radius by its eigenvalues.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

STATUS = {
    -1: "a trial point could not be evaluated",
    0: "the limit of evaluations was reached",
    1: "gradient below gtol",
    2: "cost change below ftol",
    3: "step below xtol",
    4: "cost change below ftol and step below xtol",
    5: "stopped by a callback",
}


@dataclass
class Outcome:
    theta: np.ndarray
    state: object
    status: int
    nfev: int
    nit: int
    optimality: float
    history: list = field(default_factory=list)

    @property
    def success(self) -> bool:
        return self.status > 0

    @property
    def message(self) -> str:
        return STATUS[self.status]


class Stop(Exception):
    """Raised by a callback to end a fit."""


def trust_step(a: np.ndarray, g: np.ndarray, radius: float) -> np.ndarray:
    """Minimiser of g's + s'as/2 with |s| <= radius, through the eigenvalues of a."""
    lam, q = np.linalg.eigh((a + a.T) / 2)
    lam, b = np.maximum(lam, 0), q.T @ g
    floor = lam[-1] * len(g) * np.finfo(float).eps
    if lam[0] > floor:
        s = -b / lam
        if np.linalg.norm(s) <= radius:
            return q @ s
    # |s(mu)| falls with mu; Newton on 1/|s| - 1/radius, inside a bracket
    lo, hi = 0.0, np.linalg.norm(b) / radius
    mu = hi * 1e-3 if lam[0] <= floor else 0.0
    for _ in range(60):
        d = lam + mu
        if d.min() <= 0:
            mu = max(1e-12 * max(lam[-1], 1e-300), (lo + hi) / 2)
            d = lam + mu
        s = -b / d
        n = np.linalg.norm(s)
        if abs(n - radius) <= 1e-6 * radius:
            break
        lo, hi = (mu, hi) if n > radius else (lo, mu)
        slope = (b * b / d**3).sum() / n
        step = mu + (n - radius) / radius * n / slope if slope > 0 else mu
        mu = step if lo < step < hi else (lo + hi) / 2
        if hi - lo <= 1e-15 * max(hi, 1e-300):
            break
    n = np.linalg.norm(s)
    return q @ (s * min(1.0, radius / n)) if n > 0 else q @ s


def room(theta: np.ndarray, g: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Distance to the bound that descent heads for; 1 without one."""
    v = np.ones_like(theta)
    down, up = (g > 0) & np.isfinite(lo), (g < 0) & np.isfinite(hi)
    v[down], v[up] = (theta - lo)[down], (hi - theta)[up]
    return v


def inside(theta: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Strictly between the bounds."""
    gap = np.where(np.isfinite(hi - lo), hi - lo, 1.0)
    pad = np.minimum(1e-8 * np.maximum(1, np.abs(theta)), gap / 4)
    return np.clip(theta, np.where(np.isfinite(lo), lo + pad, lo), np.where(np.isfinite(hi), hi - pad, hi))


def shortened(theta: np.ndarray, s: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> float:
    """Largest t in (0, 1] with theta + t s inside the bounds."""
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(s > 0, (hi - theta) / s, np.where(s < 0, (lo - theta) / s, np.inf))
    return float(min(1.0, np.nanmin(t, initial=np.inf)))


class Dense:
    """The quadratic g's + s'as/2 of one iterate in scaled variables, with a as an array."""

    def __init__(self, a: np.ndarray, g: np.ndarray):
        self.a, self.g = a, g

    def times(self, s: np.ndarray) -> np.ndarray:
        return self.a @ s

    def step(self, radius: float) -> tuple:
        """(s, as) of the step within the radius; where eigenvalues fail, by a decomposition that falls back."""
        try:
            s = trust_step(self.a, self.g, radius)
        except np.linalg.LinAlgError:
            from .guard import robust_svd

            u, w, v, _ = robust_svd(self.a)
            s = -v.T @ np.where(w > np.finfo(float).eps * len(w) * w[0], (u.T @ self.g) / np.where(w > 0, w, 1.0), 0.0)
            n = np.linalg.norm(s)
            s = s * min(1.0, radius / n) if n > 0 else s
        return s, self.a @ s


def quadratic(state, d: np.ndarray, extra: np.ndarray | None):
    """The model of the cost in variables scaled by d; wide states bring their own, which need no k x k array."""
    g = state.g * d
    if hasattr(state, "quadratic"):
        return state.quadratic(d, g, np.zeros_like(d) if extra is None else extra)
    a = state.a * np.outer(d, d)
    return Dense(a if extra is None else a + np.diag(extra), g)


def diagonal(state) -> np.ndarray:
    return state.diagonal if hasattr(state, "diagonal") else np.diag(state.a)


def linear_solution(state) -> np.ndarray:
    """Minimum of the quadratic that a State describes, by the eigenvalues of the scaled J'J."""
    k = len(state.theta)
    d = np.sqrt(np.maximum(np.diag(state.a), 0))
    d = np.where(d > 0, d, 1.0)
    lam, q = np.linalg.eigh(state.a / np.outer(d, d))
    keep = lam > np.finfo(float).eps * k * max(lam[-1], 0)
    return state.theta - (q[:, keep] / lam[keep]) @ (q[:, keep].T @ (state.g / d)) / d


def solved(state):
    """Generator, like iterate(). For residuals linear in the parameters: the normal equations' solution, and once
    more for what rounding left."""
    note = lambda i: {"iteration": i, "cost": state.cost, "g_norm": float(np.abs(state.g).max()), "theta": state.theta.copy()}
    history = [note(0)]
    for i in (1, 2):
        trial = yield linear_solution(state)
        if not trial.usable or trial.cost > state.cost:
            break
        state = trial
        history.append(note(i))
    return Outcome(state.theta, state, 2, i + 1, len(history) - 1, history[-1]["g_norm"], history)


def minimise(problem, theta, lo=None, hi=None, ftol=1e-10, xtol=1e-10, gtol=1e-10, max_nfev: int | None = None, callback=None, linear: bool = False) -> Outcome:
    """Fit from theta. callback(iteration, cost, theta, info) may raise Stop. linear: the residuals are linear in theta."""
    return driven(problem, iterate(theta, lo, hi, ftol, xtol, gtol, max_nfev, callback, linear))


def driven(problem, solver):
    """What a solver returns, answered by problem."""
    ask = next(solver)
    while True:
        try:
            ask = solver.send(problem(ask))
        except StopIteration as end:
            return end.value


def lockstep(answer, solvers: dict) -> dict:
    """key -> Outcome, or the ValueError it ended with. Solvers go on together: answer({key: theta}) gives all States
    that one round asks for, whatever the number of keys."""
    asks, out = {key: next(s) for key, s in solvers.items()}, {}
    while asks:
        states, new = answer(asks), {}
        for key in asks:
            try:
                new[key] = solvers[key].send(states[key])
            except StopIteration as end:
                out[key] = end.value
            except (ValueError, np.linalg.LinAlgError) as e:
                out[key] = e
        asks = new
    return out


def iterate(theta, lo=None, hi=None, ftol=1e-10, xtol=1e-10, gtol=1e-10, max_nfev: int | None = None, callback=None, linear: bool = False):
    """Generator of one fit: yields the theta it needs the State of, takes it by send(), returns an Outcome."""
    theta = np.asarray(theta, float)
    k = len(theta)
    lo = np.full(k, -np.inf) if lo is None else np.asarray(lo, float)
    hi = np.full(k, np.inf) if hi is None else np.asarray(hi, float)
    if (lo >= hi).any():
        raise ValueError("every lower bound must lie below its upper bound")
    bounded = bool(np.isfinite(lo).any() or np.isfinite(hi).any())
    theta = inside(theta, lo, hi) if bounded else theta
    state = yield theta
    if not state.usable:
        raise ValueError("the model is not finite at the starting values")
    wide = hasattr(state, "quadratic")
    if linear and not bounded and callback is None and not wide:
        return (yield from solved(state))
    nfev, nit, status, history = 1, 0, None, []
    limit = max_nfev or 100 * k
    norms = np.zeros(k)
    radius = None
    while True:
        v = room(theta, state.g, lo, hi) if bounded else np.ones(k)
        optimality = float(np.abs(state.g * v).max())
        history.append({"iteration": nit, "cost": state.cost, "g_norm": optimality, "theta": theta.copy()})
        if callback:
            try:
                callback(nit, state.cost, theta, {"nfev": nfev, "g_norm": optimality})
            except Stop:
                status = 5
        if status is None and optimality < gtol:
            status = 1
        if status is not None or nfev >= limit:
            break
        norms = np.maximum(norms, np.sqrt(np.maximum(diagonal(state), 0)))
        d = np.sqrt(v) / np.where(norms > 0, norms, 1.0)
        # in bounds, with what the scaling adds to the Hessian: |g| dv/dtheta
        local = quadratic(state, d, np.abs(state.g) * (v != 1) * d * d / v if bounded else None)
        g = local.g
        if radius is None:
            radius = np.inf if wide and linear else np.linalg.norm(theta / d) or 1.0
        moved = False
        while not moved and nfev < limit:
            s, bent = local.step(radius)
            step = d * s
            t = 1.0
            if bounded:
                t = shortened(theta, step, lo, hi)
                t *= max(0.995, 1 - optimality) if t < 1 else 1
                down = local.times(g)
                c = min(radius / max(np.linalg.norm(g), 1e-300), (g @ g) / max(g @ down, 1e-300))
                tc = shortened(theta, -c * d * g, lo, hi) * 0.995
                if -tc * c * (g @ g) + (tc * c) ** 2 * (g @ down) / 2 < t * (g @ s) + t * t * (s @ bent) / 2:
                    s, bent, step, t = -c * g, -c * down, -c * d * g, tc
            s, bent, step = t * s, t * bent, t * step
            predicted = -(g @ s + s @ bent / 2)
            trial = yield (inside(theta + step, lo, hi) if bounded else theta + step)
            nfev += 1
            if not trial.usable:
                radius = 0.25 * np.linalg.norm(s)
                if radius < 1e-14:
                    status = -1
                    break
                continue
            actual = state.cost - trial.cost
            ratio = actual / predicted if predicted > 0 else 0.0
            n = np.linalg.norm(s)
            if ratio < 0.25:
                radius = 0.25 * n
            elif ratio > 0.75 and n > 0.95 * radius:
                radius *= 2
            small_f = abs(actual) < ftol * state.cost and ratio > 0.25
            small_x = np.linalg.norm(step) < xtol * (xtol + np.linalg.norm(theta))
            status = 4 if small_f and small_x else 2 if small_f else 3 if small_x else None
            if actual > 0:
                theta, state, moved = trial.theta, trial, True
            if status is not None:
                break
        nit += 1
        if status is not None:
            v = room(theta, state.g, lo, hi) if bounded else np.ones(k)
            optimality = float(np.abs(state.g * v).max())
            history.append({"iteration": nit, "cost": state.cost, "g_norm": optimality, "theta": theta.copy()})
            break
    return Outcome(theta, state, status or 0, nfev, nit, optimality, history)
