"""Normal equations of a model over all rows: one aggregate for cost, gradient and J'J.

Residuals are w (f - y). With a loss, rows are rescaled so that J'J and J'r are those of the robust
cost. For wide models (more than SQL_WIDTH parameters) tasks sum numpy blocks instead of columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.losses import loss
from ..functions.models import Model
from . import frame

SQL_WIDTH = 12
LOCAL_ROWS = 50_000
FAN = 64  # triangles that one task stacks
LOST = 1e6  # condition of J beyond which J'J has lost most of its digits
_EPS = float(np.finfo(float).eps)


@dataclass
class State:
    """What one pass over the rows gives at theta."""

    theta: np.ndarray
    cost: float
    g: np.ndarray
    a: np.ndarray
    n: int
    bad: int
    ssr: float

    @property
    def usable(self) -> bool:
        return self.bad == 0 and np.isfinite(self.cost) and bool(np.isfinite(self.g).all() and np.isfinite(self.a).all())


def columns(model: Model) -> dict:
    return {v: f"v_{v}" for v in model.variables}


def terms(model: Model, theta, which="linear", scale: float = 1.0) -> dict:
    """Columns of a frame of points(): r, cost, gradient factors and weight of J'J for each row."""
    p = dict(zip(model.params, theta))
    cols = columns(model)
    r = F.col("w") * (E.to_column(model.expr, p, cols) - F.col("y"))
    js = [F.col("w") * E.to_column(g, p, cols) for g in model.gradient]
    if which == "linear":
        return {"r": r, "cost": 0.5 * r * r, "rho1": F.lit(1.0), "hess": F.lit(1.0), "j": js}
    z = (r / scale) * (r / scale)
    rho, first, second = (E.to_column(e, {}, {"z": z}) for e in loss(which))
    return {"r": r, "cost": 0.5 * scale * scale * rho, "rho1": first, "hess": F.greatest(first + 2 * second * z, F.lit(_EPS)), "j": js}


def aggregates(t: dict, m: Column | None = None) -> list:
    """Sums over rows, each counted m times, in the order that unpacked() reads them."""
    js = t["j"]
    k = len(js)
    ok = ~F.isnan(t["cost"]) & t["cost"].isNotNull() & (F.abs(t["cost"]) < float("inf"))
    count = (lambda c: F.count(c)) if m is None else lambda c: F.coalesce(F.sum(F.when(c.isNotNull(), m)), F.lit(0.0)).cast("long")
    total = (lambda c: F.sum(c)) if m is None else lambda c: F.sum(m * c)
    out = [count(F.lit(1)).alias("n"), count(F.when(~ok | ok.isNull(), 1)).alias("bad"), total(t["cost"]).alias("cost"), total(t["r"] * t["r"]).alias("ssr")]
    out += [total(t["rho1"] * t["r"] * js[i]).alias(f"g{i}") for i in range(k)]
    return out + [total(t["hess"] * js[i] * js[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]


def unpacked(row, theta) -> State:
    k = len(theta)
    value = lambda x: np.nan if x is None else float(x)
    g = np.array([value(row[f"g{i}"]) for i in range(k)])
    a = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = value(row[f"a{i}_{j}"])
    return State(np.asarray(theta, float), value(row["cost"]), g, a, row["n"], row["bad"], value(row["ssr"]))


def block_terms(model: Model, theta: np.ndarray, v: dict, y: np.ndarray, w: np.ndarray, which, scale: float, m: np.ndarray | None = None) -> tuple:
    """(scaled residuals, scaled Jacobian, cost, ssr, bad) of a block in numpy, whose rows count m times."""
    m = np.ones(len(y)) if m is None else m
    with np.errstate(all="ignore"):
        r = w * (model.values(theta, v) - y)
        j = w[:, None] * model.jacobian(theta, v)
        bad, ssr, often = int(m[~np.isfinite(r)].sum()), (m * r) @ r, np.sqrt(m)
        if which == "linear":
            return often * r, often[:, None] * j, 0.5 * ssr, ssr, bad
        z = (r / scale) ** 2
        rho, first, second = (np.broadcast_to(E.to_numpy(e)({}, {"z": z}), z.shape) for e in loss(which))
        h = np.sqrt(np.maximum(first + 2 * second * z, _EPS))
        return often * r * first / h, j * (often * h)[:, None], 0.5 * scale * scale * (m * rho).sum(), ssr, bad


class Problem:
    """Evaluates a model on points(). Frames of up to LOCAL_ROWS rows are fetched once and summed here; of others, rows
    that repeat are summed once and counted as often (frame.repeated)."""

    def __init__(self, pts: DataFrame, model: Model, which="linear", scale: float = 1.0, local_rows: int = LOCAL_ROWS, solver: str = "normal"):
        self.solver = solver
        self.pts, self.model, self.which, self.scale = pts, model, which, scale
        self.calls, self.block = 0, None
        cols = [f"v_{v}" for v in model.variables] + ["y", "w"]
        self.kept = "_m" in pts.columns  # whoever counted the rows keeps them
        self.pts = pts if self.kept else pts.select(*cols)
        t = self.pts.toPandas() if local_rows and not self.kept and self.pts.count() <= local_rows else None
        if t is None:
            self.pts = self.pts if self.kept else frame.repeated(self.pts).persist()
        else:
            self.block = {v: t[f"v_{v}"].to_numpy(float) for v in model.variables}, t["y"].to_numpy(float), t["w"].to_numpy(float)

    def close(self) -> None:
        if not self.kept:
            self.pts.unpersist()

    def __call__(self, theta) -> State:
        """With solver "qr", steps come from a triangle; with "auto", from the first point on where J'J loses digits."""
        state = self.summed(theta)
        if self.solver == "auto" and state.usable and condition(state) > LOST:
            self.solver = "qr"
        if self.solver != "qr" or not state.usable:
            return state
        return TriangleState(state.theta, state.cost, state.g, state.a, state.n, state.bad, state.ssr, self.triangle(state.theta))

    def summed(self, theta) -> State:
        self.calls += 1
        theta = np.asarray(theta, float)
        if self.block is not None:
            r, j, cost, ssr, bad = block_terms(self.model, theta, *self.block, self.which, self.scale)
            return State(theta, float(cost), j.T @ r, j.T @ j, len(r), bad, float(ssr))
        if len(theta) <= SQL_WIDTH and self.model.expr is not None:
            return unpacked(self.pts.agg(*aggregates(terms(self.model, theta, self.which, self.scale), F.col("_m"))).first(), theta)
        return self.by_blocks(theta)

    def by_blocks(self, theta: np.ndarray) -> State:
        """J'J summed in tasks by numpy; a row of sums per task, added up by Spark."""
        model, which, scale, k = self.model, self.which, self.scale, len(theta)

        def run(batches):
            total, any_ = np.zeros(4 + k + k * k), False
            for b in batches:
                v = {x: b.column(f"v_{x}").to_numpy() for x in model.variables}
                m = b.column("_m").to_numpy()
                r, j, cost, ssr, bad = block_terms(model, theta, v, b.column("y").to_numpy(), b.column("w").to_numpy(), which, scale, m)
                total += np.concatenate([[m.sum(), bad, cost, ssr], j.T @ r, (j.T @ j).ravel()])
                any_ = True
            if any_:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "s"])

        rows = self.pts.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
        t = np.zeros(4 + k + k * k)
        for r in rows:
            t[r.i] = r.s
        return State(theta, t[2], t[4 : 4 + k], t[4 + k :].reshape(k, k), int(t[0]), int(t[1]), t[3])

    def population(self, thetas: dict) -> dict:
        """key -> State at each theta: one job for all; a row of sums per task and theta, added up by Spark."""
        if self.block is not None:
            return {key: self(theta) for key, theta in thetas.items()}
        model, which, scale = self.model, self.which, self.scale
        every, k = [np.asarray(t, float) for t in thetas.values()], len(self.model.params)

        def run(batches):
            total = np.zeros((len(every), 4 + k + k * k))
            for b in batches:
                v = {x: b.column(f"v_{x}").to_numpy() for x in model.variables}
                y, w, m = (b.column(c).to_numpy() for c in ("y", "w", "_m"))
                for i, theta in enumerate(every):
                    r, j, cost, ssr, bad = block_terms(model, theta, v, y, w, which, scale, m)
                    total[i] += np.concatenate([[m.sum(), bad, cost, ssr], j.T @ r, (j.T @ j).ravel()])
            at = np.indices(total.shape, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at[0].ravel()), pa.array(at[1].ravel()), pa.array(total.ravel())], ["t", "i", "s"])

        t = np.zeros((len(every), 4 + k + k * k))
        for r in self.pts.mapInArrow(run, "t int, i int, s double").groupBy("t", "i").agg(F.sum("s").alias("s")).collect():
            t[r.t, r.i] = r.s
        self.calls += 1
        return {key: State(theta, s[2], s[4 : 4 + k], s[4 + k :].reshape(k, k), int(s[0]), int(s[1]), s[3]) for key, theta, s in zip(thetas, every, t)}

    def triangle(self, theta) -> np.ndarray:
        """R of the QR of [J | r]: each task's triangle, then triangles of FAN triangles, twice over, then here: the driver
        gets one of every FAN^2 tasks. Keeps cond(J) unsquared."""
        model, which, scale = self.model, self.which, self.scale
        theta = np.asarray(theta, float)
        if self.block is not None:
            r, j, *_ = block_terms(model, theta, *self.block, which, scale)
            return stacked([np.column_stack([j, r])], len(theta) + 1)
        width = len(theta) + 1

        def run(batches):
            from pyspark import TaskContext

            top = []
            for b in batches:
                v = {x: b.column(f"v_{x}").to_numpy() for x in model.variables}
                r, j, *_ = block_terms(model, theta, v, b.column("y").to_numpy(), b.column("w").to_numpy(), which, scale, b.column("_m").to_numpy())
                top = [stacked([*top, np.column_stack([j, r])], width)]
            if top:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([top[0].ravel()], pa.list_(pa.float64()))], ["part", "r"])

        def merge(table):
            rows = [np.array(x).reshape(-1, width) for x in table.column("r").to_pylist()]
            return pa.table([pa.array([table.column("part")[0].as_py()], pa.int64()), pa.array([stacked(rows, width).ravel()], pa.list_(pa.float64()))], ["part", "r"])

        parts = self.pts.mapInArrow(run, "part long, r array<double>")
        for _ in range(2):
            parts = parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(merge, "part long, r array<double>")
        return stacked([np.array(x.r).reshape(-1, width) for x in parts.orderBy("part").collect()], width)


def stacked(blocks: list, width: int) -> np.ndarray:
    """The upper triangle, width x width, of the QR of blocks of rows; a block that is not finite makes it NaN."""
    m = np.vstack([*blocks, np.zeros((0, width))])
    if not np.isfinite(m).all():
        return np.full((width, width), np.nan)
    r = np.linalg.qr(m, mode="r")
    return np.vstack([r, np.zeros((width - len(r), width))])


class Triangle:
    """Steps from R of [J | r] in scaled variables, by its singular values, which are those of J and not their squares."""

    def __init__(self, r: np.ndarray, d: np.ndarray, extra: np.ndarray):
        k = len(d)
        self.top, self.z = np.vstack([r[:k, :k] * d, np.diag(np.sqrt(extra))]), np.concatenate([r[:k, k], np.zeros(k)])
        self.g = self.top.T @ self.z

    def times(self, s: np.ndarray) -> np.ndarray:
        return self.top.T @ (self.top @ s)

    def step(self, radius: float) -> tuple:
        u, w, v = np.linalg.svd(self.top, full_matrices=False)
        b = u.T @ self.z
        keep = w > _EPS * len(w) * w[0]
        s = np.where(keep, -b / np.where(keep, w, 1.0), 0.0)
        if np.linalg.norm(s) > radius:  # w b / (w^2 + mu), with mu by bisection on a falling length
            lo, hi = 0.0, np.linalg.norm(w * b) / radius
            for _ in range(200):
                mu = (lo + hi) / 2
                s = -w * b / (w * w + mu)
                n = np.linalg.norm(s)
                if abs(n - radius) <= 1e-9 * radius or hi - lo <= 1e-15 * hi:
                    break
                lo, hi = (mu, hi) if n > radius else (lo, mu)
        s = v.T @ s
        return s, self.times(s)


class Logged:
    """A Problem whose evaluations go through a storage.Log."""

    def __init__(self, problem: Problem, log):
        self.problem, self.log = problem, log

    def close(self) -> None:
        self.problem.close()

    @staticmethod
    def packed(s: State) -> dict:
        more = {"r": s.r.tolist()} if isinstance(s, TriangleState) else {}
        return {"theta": s.theta.tolist(), "cost": float(s.cost), "g": s.g.tolist(), "a": s.a.tolist(), "n": int(s.n), "bad": int(s.bad), "ssr": float(s.ssr)} | more

    @staticmethod
    def unpacked(e: dict) -> State:
        make = TriangleState if "r" in e else State
        return make(**{k: np.array(v, float) if isinstance(v, list) else v for k, v in e.items()})

    def __call__(self, theta) -> State:
        asked = np.asarray(theta, float).tolist()
        return self.unpacked(self.log.answer("point", asked, lambda: self.packed(self.problem(theta))))

    def population(self, thetas: dict) -> dict:
        keys, asked = list(thetas), [np.asarray(t, float).tolist() for t in thetas.values()]

        def compute():
            found = self.problem.population(thetas)
            return [self.packed(found[k]) for k in keys]

        return dict(zip(keys, map(self.unpacked, self.log.answer("points", asked, compute))))


@dataclass
class TriangleState(State):
    """A State whose steps and covariance come from R of [J | r] rather than from J'J."""

    r: np.ndarray | None = None

    @property
    def diagonal(self) -> np.ndarray:
        return np.diag(self.a)

    def quadratic(self, d: np.ndarray, g: np.ndarray, extra: np.ndarray) -> Triangle:
        return Triangle(self.r, d, extra)

    def inverse(self) -> tuple:
        """(pseudo-inverse of J'J, rank), by the singular values of R with columns of unit length."""
        k = len(self.theta)
        d = np.sqrt(np.maximum(np.diag(self.a), 0))
        d = np.where(d > 0, d, 1.0)
        _, w, v = np.linalg.svd(self.r[:k, :k] / d)
        keep = w > _EPS * k * w[0]
        return (v[keep].T / w[keep] ** 2) @ v[keep] / np.outer(d, d), int(keep.sum())


def condition(state: State) -> float:
    """Condition of J with columns of unit length, as far as J'J can tell."""
    d = np.sqrt(np.maximum(np.diag(state.a), 0))
    lam = np.linalg.eigvalsh(state.a / np.outer(np.where(d > 0, d, 1.0), np.where(d > 0, d, 1.0)))
    return float(np.sqrt(lam[-1] / lam[0])) if lam[0] > 0 else np.inf


def residual_column(model: Model, theta) -> Column:
    """y - f, unweighted, over a frame of points()."""
    return F.col("y") - model.column(theta, columns(model))
