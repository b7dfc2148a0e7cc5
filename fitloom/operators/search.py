"""Global search: samplers, multi-start, tournament, CMA-ES. A population is evaluated in one job."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.losses import loss
from ..functions.models import Model, named
from . import frame, normal, solve
from .fit import FitResult, covariance
from .storage import Log

PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71)
#: Joe and Kuo's primitive polynomials (degree, coefficients) and initial direction numbers.
JOE_KUO = (
    (1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)),
    (5, 2, (1, 1, 5, 5, 17)), (5, 4, (1, 1, 5, 5, 5)), (5, 7, (1, 1, 7, 11, 19)), (5, 11, (1, 1, 5, 1, 1)), (5, 13, (1, 1, 1, 3, 11)), (5, 14, (1, 3, 5, 5, 31)),
    (6, 1, (1, 3, 3, 9, 7, 49)), (6, 13, (1, 1, 1, 15, 21, 21)), (6, 16, (1, 3, 1, 13, 27, 49)), (6, 19, (1, 1, 1, 15, 7, 5)), (6, 22, (1, 3, 1, 15, 13, 25)), (6, 25, (1, 1, 5, 5, 19, 61)),
    (7, 1, (1, 3, 7, 11, 23, 15, 103)), (7, 4, (1, 3, 7, 13, 13, 15, 69)),
)


def latin_hypercube(n: int, k: int, seed: int = 0) -> np.ndarray:
    """One point in each of n strata of every dimension."""
    r = np.random.default_rng(seed)
    return np.stack([(r.permutation(n) + r.random(n)) / n for _ in range(k)], 1)


def radical_inverse(i: np.ndarray, base: int) -> np.ndarray:
    i, out, f = i.copy(), np.zeros(len(i)), 1.0
    while i.any():
        f /= base
        out += f * (i % base)
        i //= base
    return out


def halton(n: int, k: int, skip: int = 1) -> np.ndarray:
    if k > len(PRIMES):
        raise ValueError(f"at most {len(PRIMES)} dimensions")
    return np.stack([radical_inverse(np.arange(skip, skip + n), b) for b in PRIMES[:k]], 1)


def halton_table(df: DataFrame, index: str, k: int, digits: int = 40) -> DataFrame:
    """Halton coordinates h1..hk of an integer column, as columns."""
    def next_digit(b):
        return lambda acc, _: F.struct(F.floor(acc["i"] / b).alias("i"), (acc["f"] / b).alias("f"), (acc["s"] + acc["f"] / b * F.pmod(acc["i"], F.lit(b))).alias("s"))

    for d, b in enumerate(PRIMES[:k]):
        n = max(1, math.ceil(digits / math.log2(b)))
        start = F.struct(F.col(index).cast("long").alias("i"), F.lit(1.0).cast("double").alias("f"), F.lit(0.0).cast("double").alias("s"))
        df = df.withColumn(f"h{d + 1}", F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, next_digit(b), lambda acc: acc["s"]))
    return df


def sobol(n: int, k: int, bits: int = 32) -> np.ndarray:
    if k > len(JOE_KUO) + 1:
        raise ValueError(f"at most {len(JOE_KUO) + 1} dimensions")
    out = np.zeros((n, k))
    for d in range(k):
        if d == 0:
            v = [1 << (bits - 1 - i) for i in range(bits)]
        else:
            s, a, m = JOE_KUO[d - 1]
            v = [m[i] << (bits - 1 - i) for i in range(s)]
            for i in range(s, bits):
                x = v[i - s] ^ (v[i - s] >> s)
                for j in range(1, s):
                    if a >> (s - 1 - j) & 1:
                        x ^= v[i - j]
                v.append(x)
        x = 0
        for i in range(1, n):
            x ^= v[(i & -i).bit_length() - 1]  # Gray code order
            out[i, d] = x / 2.0**bits
    return out


SAMPLERS = {"lhs": latin_hypercube, "halton": lambda n, k, seed=0: halton(n, k), "sobol": lambda n, k, seed=0: sobol(n, k)}


def scaled(u: np.ndarray, lo, hi, centre=None, spread: float = 1.0) -> np.ndarray:
    """Unit cube to bounds; with centre, a box of `spread` of the width around it, kept inside."""
    lo, hi = np.asarray(lo, float), np.asarray(hi, float)
    if centre is None:
        return lo + u * (hi - lo)
    return np.clip(centre + (u - 0.5) * spread * (hi - lo), lo, hi)


def to_unbounded(x: np.ndarray, lo, hi, eps: float = 1e-8) -> np.ndarray:
    """Logit of the place between finite bounds; other coordinates stay."""
    lo, hi = np.broadcast_to(lo, np.shape(x)), np.broadcast_to(hi, np.shape(x))
    both = np.isfinite(lo) & np.isfinite(hi)
    out = np.array(x, float)
    u = np.clip((out[both] - lo[both]) / (hi[both] - lo[both]), eps, 1 - eps)
    out[both] = np.log(u / (1 - u))
    return out


def to_bounded(z: np.ndarray, lo, hi) -> np.ndarray:
    lo, hi = np.broadcast_to(lo, np.shape(z)), np.broadcast_to(hi, np.shape(z))
    both = np.isfinite(lo) & np.isfinite(hi)
    out = np.array(z, float)
    out[both] = lo[both] + (hi[both] - lo[both]) / (1 + np.exp(-np.clip(out[both], -700, 700)))
    return out


def block_costs(model: Model, thetas: np.ndarray, v: dict, y: np.ndarray, w: np.ndarray, which, scale: float, m: np.ndarray | None = None) -> np.ndarray:
    """(candidates, 2): cost and rows of a block, whose rows count m times."""
    m = np.ones(len(y)) if m is None else m
    rho = E.to_numpy(loss(which)[0])
    out = np.zeros((len(thetas), 2))
    for i, theta in enumerate(thetas):
        with np.errstate(all="ignore"):
            r = w * (model.values(theta, v) - y)
            out[i] = 0.5 * scale * scale * np.sum(m * rho({}, {"z": (r / scale) ** 2})), m.sum()
    return out


def population_costs(pts: DataFrame, model: Model, thetas: np.ndarray, which="linear", scale: float = 1.0, batch=None) -> np.ndarray:
    """(candidates, 2): cost and rows. Tasks sum all candidates block by block; no row is multiplied."""
    thetas = np.asarray(thetas, float)
    rows = pts if batch is None else pts.filter(F.pmod(F.xxhash64("ord", "y"), F.lit(batch[1])) == batch[0])

    counted = "_m" in pts.columns

    def run(batches):
        total = np.zeros((len(thetas), 2))
        for b in batches:
            v = {x: b.column(f"v_{x}").to_numpy() for x in model.variables}
            total += block_costs(model, thetas, v, b.column("y").to_numpy(), b.column("w").to_numpy(), which, scale, b.column("_m").to_numpy() if counted else None)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(thetas), dtype=np.int32)), pa.array(total[:, 0]), pa.array(total[:, 1])], ["i", "cost", "n"])

    out = np.full((len(thetas), 2), np.inf)
    out[:, 1] = 0
    for r in rows.mapInArrow(run, "i int, cost double, n double").groupBy("i").agg(F.sum("cost").alias("c"), F.sum("n").alias("n")).collect():
        out[r.i] = (r.c if np.isfinite(r.c) else np.inf), r.n
    return out


def ranked(spark, thetas: np.ndarray, costs: np.ndarray, params: tuple) -> DataFrame:
    """start_id, cost, parameters and rank, best first."""
    order = np.lexsort((np.arange(len(costs)), costs))
    rows = [(int(i), float(costs[i]), *map(float, thetas[i]), n + 1) for n, i in enumerate(order)]
    return spark.createDataFrame(rows, "start_id int, cost double, " + ", ".join(f"`{p}` double" for p in params) + ", rank int")


@dataclass
class Setup:
    """A search's points; those that stay where they are also counted (frame.repeated), and kept until it ends."""

    model: Model
    pts: DataFrame
    lo: np.ndarray
    hi: np.ndarray
    block: tuple | None = None
    local_rows: int = normal.LOCAL_ROWS
    log: Log | None = None
    counted: DataFrame | None = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.counted is not None:
            self.counted.unpersist()

    def logged(self, kind: str, thetas: np.ndarray, compute) -> np.ndarray:
        return compute() if self.log is None else np.array(self.log.answer(kind, np.asarray(thetas, float).tolist(), lambda: compute().tolist()), float)

    def problem(self, which="linear", scale: float = 1.0):
        found = normal.Problem(self.pts if self.counted is None else self.counted, self.model, which, scale, self.local_rows)
        return found if self.log is None else normal.Logged(found, self.log)

    def costs(self, thetas: np.ndarray, which="linear", scale: float = 1.0) -> np.ndarray:
        """Costs of a population: here if the points are few, else one job."""
        return self.logged("costs", thetas, lambda: self.costs_now(thetas, which, scale))

    def costs_now(self, thetas: np.ndarray, which, scale: float) -> np.ndarray:
        if self.block is None:
            return population_costs(self.counted, self.model, thetas, which, scale)[:, 0]
        c = block_costs(self.model, thetas, *self.block, which, scale)[:, 0]
        return np.where(np.isfinite(c), c, np.inf)


def prepared(df, model, x, y, bounds, sigma, nan_policy, local_rows: int = normal.LOCAL_ROWS, log: str | None = None) -> Setup:
    """log: a folder shared by driver and executors; a search that is stopped and started again with it goes on from there."""
    model = named(model)
    pts = frame.points(df, frame.Roles.of(x, y, model.variables, sigma=sigma), nan_policy)
    lo, hi = (np.broadcast_to(np.asarray(b, float), len(model.params)).copy() for b in bounds)
    if not (np.isfinite(lo).all() and np.isfinite(hi).all()):
        raise ValueError("a global search needs finite bounds")
    block = None
    t = pts.toPandas() if local_rows and pts.count() <= local_rows else None
    if t is not None:
        block = {v: t[f"v_{v}"].to_numpy(float) for v in model.variables}, t["y"].to_numpy(float), t["w"].to_numpy(float)
    log = None if log is None else Log(df.sparkSession, log)
    counted = frame.repeated(pts.drop("ord")).persist() if block is None else None
    return Setup(model, pts, lo, hi, block, local_rows, log, counted)


def finish(s: Setup, theta: np.ndarray, which, f_scale: float, nfev: int = 0) -> FitResult:
    """Local fit from the best candidate."""
    problem = s.problem(which, f_scale)
    try:
        out = solve.minimise(problem, theta, s.lo, s.hi)
    finally:
        problem.close()
    out.nfev += nfev
    return FitResult(s.model, out.theta, covariance(out.state)[0], out, s.pts)


def multi_start(df, model, x, y, bounds, n_starts: int = 20, sampler: str = "lhs", p0=None, keep: int | None = None, sigma=None, which="linear", f_scale: float = 1.0, seed: int = 0, nan_policy="raise", local_rows: int = normal.LOCAL_ROWS, log: str | None = None) -> FitResult:
    """Every start is fitted and the best fit is returned. The fits advance together, one job a round for all that
    are still on their way. keep: fit only so many starts, those of least cost; None fits all."""
    with prepared(df, model, x, y, bounds, sigma, nan_policy, local_rows, log) as s:
        thetas = scaled(SAMPLERS[sampler](n_starts, len(s.lo), seed=seed), s.lo, s.hi)
        if p0 is not None:
            thetas = np.vstack([np.clip(p0, s.lo, s.hi), thetas])
        if keep is not None:
            thetas = thetas[np.argsort(s.costs(thetas, which, f_scale), kind="stable")[:keep]]
        problem = s.problem(which, f_scale)
        try:
            found = solve.lockstep(problem.population, {i: solve.iterate(t, s.lo, s.hi) for i, t in enumerate(thetas)})
        finally:
            problem.close()
        fitted = [(o.state.cost, i, o) for i, o in found.items() if isinstance(o, solve.Outcome)]
        if not fitted:
            raise ValueError("the model is finite at no starting point")
        out = min(fitted, key=lambda x: x[:2])[2]
        out.nfev = sum(o.nfev for *_, o in fitted)
        return FitResult(s.model, out.theta, covariance(out.state)[0], out, s.pts)


def tournament(df, model, x, y, bounds, n_candidates: int = 64, rounds: int = 4, drop: float = 0.5, batches: int = 8, sampler: str = "halton", sigma=None, seed: int = 0, nan_policy="raise", local_rows: int = normal.LOCAL_ROWS, log: str | None = None) -> tuple:
    """(fit, survivors per round): each round costs the candidates on a further batch of rows and drops the worst."""
    with prepared(df, model, x, y, bounds, sigma, nan_policy, local_rows, log) as s:
        alive = scaled(SAMPLERS[sampler](n_candidates, len(s.lo), seed=seed), s.lo, s.hi)
        total, history = np.zeros((len(alive), 2)), []
        for r in range(rounds):
            total += s.logged(f"batch {r}", alive, lambda alive=alive, r=r: population_costs(s.pts, s.model, alive, batch=(r % batches, batches)))
            mean = np.where(np.isfinite(total[:, 0]), total[:, 0] / np.maximum(total[:, 1], 1), np.inf)
            keep = np.sort(np.argsort(mean, kind="stable")[: max(1, len(alive) - math.floor(drop * len(alive)))])
            alive, total = alive[keep], total[keep]
            history.append(len(alive))
            if len(alive) == 1:
                break
        costs = s.costs(alive)
        return finish(s, alive[int(np.argmin(costs))], "linear", 1.0), history


def tournament_rounds(pts: DataFrame, model, thetas: np.ndarray, batch, rounds: int, drop: float = 0.5) -> list:
    """[(round, candidate, mean cost)] of the candidates that survive each round.

    Round r adds the costs of the rows for which `batch`, a column, is r, and keeps all but the share `drop` of
    the highest means (at least one); ties go to the earlier candidate. Each round is one job."""
    model, alive = named(model), np.arange(len(thetas))
    total, out = np.zeros((len(thetas), 2)), []
    for r in range(rounds):
        total[alive] += population_costs(pts.filter(batch == r), model, np.asarray(thetas, float)[alive])
        mean = np.where(np.isfinite(total[alive, 0]), total[alive, 0] / np.maximum(total[alive, 1], 1), np.inf)
        keep = np.argsort(mean, kind="stable")[: max(1, len(alive) - math.floor(drop * len(alive)))]
        out += [(r + 1, int(alive[i]), float(mean[i])) for i in keep]
        alive = np.sort(alive[keep])
    return out


class CMA:
    """Covariance matrix adaptation: ask for a population, tell its costs."""

    def __init__(self, mean: np.ndarray, sigma: float, size: int | None = None, seed: int = 0):
        n = len(mean)
        self.n, self.mean, self.sigma, self.rng = n, np.array(mean, float), sigma, np.random.default_rng(seed)
        self.size = size or 4 + int(3 * math.log(n))
        w = math.log((self.size + 1) / 2) - np.log(np.arange(1, self.size // 2 + 1))
        self.w = w / w.sum()
        self.mu_eff = 1 / (self.w**2).sum()
        self.cs = (self.mu_eff + 2) / (n + self.mu_eff + 5)
        self.ds = 1 + self.cs + 2 * max(0.0, math.sqrt((self.mu_eff - 1) / (n + 1)) - 1)
        self.cc = (4 + self.mu_eff / n) / (n + 4 + 2 * self.mu_eff / n)
        self.c1 = 2 / ((n + 1.3) ** 2 + self.mu_eff)
        self.cm = min(1 - self.c1, 2 * (self.mu_eff - 2 + 1 / self.mu_eff) / ((n + 2) ** 2 + self.mu_eff))
        self.chi = math.sqrt(n) * (1 - 1 / (4 * n) + 1 / (21 * n * n))
        self.c, self.ps, self.pc, self.t = np.eye(n), np.zeros(n), np.zeros(n), 0

    def ask(self) -> np.ndarray:
        lam, self.q = np.linalg.eigh(self.c)
        self.d = np.sqrt(np.maximum(lam, 1e-20))
        return self.mean + self.sigma * (self.rng.normal(size=(self.size, self.n)) * self.d) @ self.q.T

    def tell(self, x: np.ndarray, costs: np.ndarray) -> None:
        best = x[np.argsort(costs, kind="stable")[: len(self.w)]]
        y = (best - self.mean) / self.sigma
        step = self.w @ y
        self.t += 1
        self.mean = self.mean + self.sigma * step
        self.ps = (1 - self.cs) * self.ps + math.sqrt(self.cs * (2 - self.cs) * self.mu_eff) * (self.q / self.d) @ self.q.T @ step
        norm = np.linalg.norm(self.ps)
        near = norm / math.sqrt(1 - (1 - self.cs) ** (2 * self.t)) < (1.4 + 2 / (self.n + 1)) * self.chi
        self.pc = (1 - self.cc) * self.pc + near * math.sqrt(self.cc * (2 - self.cc) * self.mu_eff) * step
        old = (1 - near) * self.cc * (2 - self.cc)
        self.c = (1 - self.c1 - self.cm + self.c1 * old) * self.c + self.c1 * np.outer(self.pc, self.pc) + self.cm * (y.T * self.w) @ y
        self.sigma *= math.exp(min(1.0, self.cs / self.ds * (norm / self.chi - 1)))


#: generations, restarts
PRESETS = {"fast": (60, 0), "default": (120, 2), "global": (200, 9)}


def cma_es(df, model, x, y, bounds, p0=None, preset="default", size: int | None = None, tol_x: float = 1e-8, tol_f: float = 1e-12, sigma=None, seed: int = 0, refine: bool = True, nan_policy="raise", local_rows: int = normal.LOCAL_ROWS, log: str | None = None, callback=None) -> FitResult:
    """CMA-ES over the logits of bounded parameters, one job a generation, restarted with alternately doubled
    and small populations; the best point is refined by the local solver. callback(generations, best cost) is told
    after each generation; what it raises ends the search, and with a log the next one goes on from there."""
    with prepared(df, model, x, y, bounds, sigma, nan_policy, local_rows, log) as s:
        generations, restarts = PRESETS[preset] if isinstance(preset, str) else preset
        rng, k = np.random.default_rng(seed), len(s.lo)
        base = size or 4 + int(3 * math.log(k))
        best, best_cost, nfev, large, turns = None, np.inf, 0, base, 0
        for run in range(restarts + 1):
            n = base if run == 0 else large if run % 2 else max(4, int(base * (0.5 * large / base) ** (rng.random() ** 2)))
            if run % 2:
                large *= 2
                n = large
            start = to_unbounded(np.clip(p0, s.lo, s.hi) if p0 is not None and run == 0 else scaled(rng.random(k), s.lo, s.hi), s.lo, s.hi)
            es = CMA(start, 1.0 if run % 2 or run == 0 else 2.0 * 10 ** (-2 * rng.random()), n, seed + run)
            flat = 0
            for _ in range(generations):
                z = es.ask()
                thetas = to_bounded(z, s.lo, s.hi)
                costs = s.costs(thetas)
                nfev += len(z)
                es.tell(z, costs)
                i = int(np.argmin(costs))
                if costs[i] < best_cost:
                    best, best_cost = thetas[i], costs[i]
                turns += 1
                if callback:
                    callback(turns, best_cost)
                ok = costs[np.isfinite(costs)]
                flat = flat + 1 if len(ok) and np.ptp(ok) <= tol_f * max(1, abs(ok.min())) else 0
                if flat >= 5 or es.sigma * es.d.max() < tol_x:
                    break
        if best is None:
            raise ValueError("the model is finite at no candidate")
        if refine:
            try:
                return finish(s, best, "linear", 1.0, nfev)
            except ValueError:
                pass
        state = s.problem()(best)
        out = solve.Outcome(best, state, 0, nfev, 0, float(np.abs(state.g).max()))
        return FitResult(s.model, best, np.diag(np.full(k, math.inf)), out, s.pts)


def method(lo, hi, ratio: float = 1000.0) -> str:
    """cma_es if the bounds' widths differ beyond ratio, else multi_start."""
    w = np.asarray(hi, float) - np.asarray(lo, float)
    return "cma_es" if w.max() > ratio * w.min() else "multi_start"


# ---- grids from SQL ----


def register_grid(spark, name: str, model, thetas: np.ndarray, which="linear", scale: float = 1.0) -> None:
    """Register a table function: SELECT candidate, sum(cost), sum(n) FROM <name>(TABLE(points)) GROUP BY candidate, for
    points with the model's variables, y and, if the errors differ, w.

    Each task sums its partition of the table in blocks and gives one row per candidate, so no row is multiplied and
    the shuffle holds candidates x tasks rows. Rows with a null count for nothing."""
    from pyspark.sql.functions import udtf

    model, thetas = named(model), np.asarray(thetas, float)

    @udtf(returnType="candidate int, cost double, n long")
    class Costs:
        def __init__(self):
            self.rows, self.total, self.seen = [], np.zeros((len(thetas), 2)), False

        def eval(self, row):
            self.seen = True
            values = [row[v] for v in model.variables] + [row["y"], row["w"] if "w" in row else 1.0]
            if None not in values:
                self.rows.append(values)
            if len(self.rows) >= 8192:
                self.add()

        def add(self):
            if self.rows:
                m = np.array(self.rows, float)
                self.total += block_costs(model, thetas, dict(zip(model.variables, m.T)), m[:, -2], m[:, -1], which, scale)
                self.rows = []

        def terminate(self):
            self.add()
            if self.seen:  # Spark has no row to join what an empty partition gives
                for i, (cost, n) in enumerate(self.total.tolist()):
                    yield i, cost, int(n)

    spark.udtf.register(name, Costs)
