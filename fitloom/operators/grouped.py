"""One fit per key.

A model that is linear in its parameters takes two grouped aggregates (sums at the start, sums at the
solution) and a small solve per key, so rows are summed where they are. Otherwise small groups are fitted
where they are, by the same solver on numpy blocks; keys with more than group_rows rows advance together,
one grouped aggregate per step, and are never gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import Model, named
from . import frame, normal, solve
from .fit import covariance
from .storage import written

GROUP_ROWS = 100_000
FEW = 200_000  # keys up to which their solutions, some 10 MB, are sent to every task


class Block:
    """A Problem on arrays."""

    def __init__(self, model: Model, v: dict, y: np.ndarray, w: np.ndarray, which="linear", scale: float = 1.0):
        self.args = model, v, y, w, which, scale

    def __call__(self, theta):
        model, v, y, w, which, scale = self.args
        theta = np.asarray(theta, float)
        r, j, cost, ssr, bad = normal.block_terms(model, theta, v, y, w, which, scale)
        return normal.State(theta, float(cost), j.T @ r, j.T @ j, len(r), bad, float(ssr))


def result_schema(keys: dict) -> str:
    return ", ".join(f"`{k}` {t}" for k, t in keys.items()) + ", n long, status int, success boolean, cost double, nfev int, params array<double>, stderr array<double>, error string"


def row_of(keys: tuple, n: int, out: solve.Outcome | None, absolute: bool, error: str | None = None) -> tuple:
    if out is None:
        return (*keys, n, -1, False, None, 0, None, None, error)
    pcov, _ = covariance(out.state, absolute)
    return (*keys, n, out.status, out.success, float(out.state.cost), out.nfev, out.theta.tolist(), np.sqrt(np.maximum(np.diag(pcov), 0)).tolist(), None)


def fit_by_key(
    df: DataFrame, model, x, y: str, keys: list, p0, sigma: str | None = None, bounds=None, loss="linear", f_scale: float = 1.0,
    absolute_sigma: bool = False, nan_policy: str = "omit", group_rows: int = GROUP_ROWS, steps: int = 100,
) -> DataFrame:
    """keys, n, status, success, cost, nfev, params, stderr, error: a row per key."""
    model = named(model)
    pts = frame.points(df, frame.Roles.of(x, y, model.variables, sigma=sigma, keys=tuple(keys)), nan_policy)
    plain = loss == "linear" and model.linear and model.expr is not None and len(model.params) <= normal.SQL_WIDTH
    if plain and bounds is None and not np.isfinite(np.concatenate(model.limits())).any():
        kinds = {k: t for k, t in pts.dtypes if k in keys}
        return linear_states(pts, model, keys, p0, lambda key, state: row_of(key, *outcome_of(state, absolute_sigma)), result_schema(kinds), lambda t, s, theta: rows_of(t[list(kinds)], s, theta, absolute_sigma))
    kinds = {k: t for k, t in pts.dtypes if k in keys}
    lo, hi = model.limits() if bounds is None else (np.broadcast_to(np.asarray(b, float), len(model.params)).copy() for b in bounds)
    p0, linear = np.asarray(p0, float), loss == "linear" and model.linear
    schema = result_schema(kinds)
    names = [c.split()[0].strip("`") for c in schema.split(", ")]
    sizes = pts.groupBy(*keys).agg(F.count("*").alias("_n"))
    large = sizes.filter(F.col("_n") > group_rows).drop("_n").collect()  # at most rows / group_rows keys

    def one(key, pdf):
        v = {x: pdf[f"v_{x}"].to_numpy(float) for x in model.variables}
        problem = Block(model, v, pdf["y"].to_numpy(float), pdf["w"].to_numpy(float), loss, f_scale)
        try:
            if len(pdf) < len(model.params):
                raise ValueError("fewer points than parameters")
            row = row_of(key, len(pdf), solve.minimise(problem, np.clip(p0, lo, hi), lo, hi, linear=linear), absolute_sigma)
        except (ValueError, np.linalg.LinAlgError) as e:
            row = row_of(key, len(pdf), None, absolute_sigma, str(e))
        return pd.DataFrame([row], columns=names)

    if not large:
        return pts.groupBy(*keys).applyInPandas(one, schema)
    spark = df.sparkSession
    is_large = spark.createDataFrame([tuple(r) for r in large], ", ".join(f"`{k}` {t}" for k, t in kinds.items()))
    on = [F.col(f"p.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys]
    small = pts.alias("p").join(F.broadcast(is_large.alias("q")), on, "left_anti").groupBy(*keys).applyInPandas(one, schema)
    rows = large_keys(pts, model, [tuple(r) for r in large], kinds, p0, lo, hi, loss, f_scale, steps, linear)
    done = [row_of(k, 0, None, absolute_sigma, str(o)) if isinstance(o, Exception) else row_of(k, o.state.n, o, absolute_sigma) for k, o in rows]
    return small.unionByName(spark.createDataFrame(done, schema))


def large_keys(pts: DataFrame, model: Model, large: list, kinds: dict, p0, lo, hi, which, scale: float, steps: int, linear: bool = False) -> list:
    """[(key, Outcome)]: a solver for every key."""
    return list(advanced(pts, model, {key: solve.iterate(np.clip(p0, lo, hi), lo, hi, max_nfev=steps, linear=linear) for key in large}, kinds, which, scale).items())


def advanced(pts: DataFrame, model: Model, solvers: dict, kinds: dict, which="linear", scale: float = 1.0) -> dict:
    """key -> what its solver ends with: every solver asks for one evaluation; all are answered by one grouped aggregate."""
    spark, k = pts.sparkSession, len(model.params)
    rows = frame.repeated(pts.select(*kinds, *(f"v_{v}" for v in model.variables), "y", "w")).persist()

    def answer(asked: dict) -> dict:
        table = spark.createDataFrame(
            [(*key, *map(float, theta)) for key, theta in asked.items()],
            ", ".join([f"`k_{c}` {t}" for c, t in kinds.items()] + [f"p{i} double" for i in range(k)]),
        )
        on = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in kinds]
        joined = rows.join(F.broadcast(table), on)
        t = normal.terms(model, [F.col(f"p{i}") for i in range(k)], which, scale)
        got = joined.groupBy(*kinds).agg(*normal.aggregates(t, F.col("_m"))).collect()
        return {tuple(r[c] for c in kinds): r for r in got}

    def states(asked):
        return {key: normal.unpacked(row, asked[key]) for key, row in answer(asked).items()}

    try:
        return solve.lockstep(states, solvers)
    finally:
        rows.unpersist()


def outcome_of(state, absolute: bool) -> tuple:
    """(n, Outcome or None, absolute, error) of the sums at a linear model's solution."""
    k = len(state.theta)
    if state.n < k:
        return state.n, None, absolute, "fewer points than parameters"
    if not state.usable:
        return state.n, None, absolute, "the model is not finite at the starting values"
    return state.n, solve.Outcome(state.theta, state, 2, 2, 1, float(np.abs(state.g).max())), absolute, None


@dataclass
class Sums:
    """The sums of many keys, as arrays by key: what unpacked() gives for one."""

    n: np.ndarray
    bad: np.ndarray
    cost: np.ndarray
    ssr: np.ndarray
    g: np.ndarray
    a: np.ndarray

    @classmethod
    def of(cls, t: pd.DataFrame, k: int) -> Sums:
        v = lambda c: t[c].to_numpy(float, na_value=np.nan)
        a = np.empty((len(t), k, k))
        for i in range(k):
            for j in range(i, k):
                a[:, i, j] = a[:, j, i] = v(f"a{i}_{j}")
        return cls(t["n"].to_numpy(np.int64), t["bad"].to_numpy(np.int64), v("cost"), v("ssr"), np.stack([v(f"g{i}") for i in range(k)], 1), a)

    @property
    def usable(self) -> np.ndarray:
        return (self.bad == 0) & np.isfinite(self.cost) & np.isfinite(self.g).all(1) & np.isfinite(self.a).all((1, 2)) & (self.n >= self.g.shape[1])

    def eigen(self) -> tuple:
        """(column norms, eigenvalues, eigenvectors) of the scaled J'J; of keys that are not usable, those of 1."""
        d = np.sqrt(np.maximum(np.diagonal(self.a, axis1=1, axis2=2), 0))
        d = np.where(d > 0, d, 1.0)
        a = np.where(self.usable[:, None, None], self.a / (d[:, :, None] * d[:, None, :]), np.eye(self.g.shape[1]))
        return d, *np.linalg.eigh(a)

    def solutions(self, theta: np.ndarray) -> np.ndarray:
        """solve.linear_solution() of every key; NaN where a key is not usable."""
        d, lam, q = self.eigen()
        keep = lam > np.finfo(float).eps * lam.shape[1] * np.maximum(lam[:, -1:], 0)
        part = np.where(keep, 1 / np.where(keep, lam, 1.0), 0.0) * np.einsum("bij,bi->bj", q, self.g / d)
        return np.where(self.usable[:, None], theta - np.einsum("bij,bj->bi", q, part) / d, np.nan)


def rows_of(keys: pd.DataFrame, s: Sums, theta: np.ndarray, absolute: bool) -> pd.DataFrame:
    """row_of() of many keys at once."""
    k, n = theta.shape[1], len(s.n)
    d, lam, q = s.eigen()
    keep = lam > np.finfo(float).eps * np.maximum(s.n, k)[:, None] * np.maximum(lam[:, -1:], 0)
    with np.errstate(all="ignore"):
        var = np.einsum("bij,bj->bi", q * q, np.where(keep, 1 / np.where(keep, lam, 1.0), 0.0)) / d**2
        var = var if absolute else var * (s.ssr / (s.n - k))[:, None]
    var[~keep.all(1) | ((s.n <= k) & (not absolute))] = np.inf
    good, err = s.usable, np.sqrt(np.maximum(var, 0))
    none = lambda values: [v if ok else None for v, ok in zip(values, good)]
    why = np.where(s.n < k, "fewer points than parameters", "the model is not finite at the starting values")
    return keys.assign(
        n=s.n, status=np.where(good, 2, -1), success=good, cost=pd.Series(none(s.cost), keys.index, object), nfev=np.where(good, 2, 0), params=pd.Series(none(list(theta)), keys.index, object),
        stderr=pd.Series(none(list(err)), keys.index, object), error=pd.Series(np.where(good, None, why), keys.index, object),
    )


def linear_states(pts: DataFrame, model: Model, keys: list, p0, row, schema: str, table=None) -> DataFrame:
    """row(key, State at the solution) of every key, for models linear in their parameters: two grouped aggregates.
    table(frame with the keys, Sums, solutions) gives the rows of many keys at once instead."""
    p0, k = np.asarray(p0, float), len(model.params)
    kinds = {c: t for c, t in pts.dtypes if c in keys}
    names, thetas = list(kinds), [f"_p{i}" for i in range(k)]
    columns = [c.split()[0].strip("`") for c in schema.split(", ")]
    sums = lambda rows, theta, by: rows.groupBy(*by).agg(*normal.aggregates(normal.terms(model, theta)))

    def solutions(pdfs):
        for pdf in pdfs:
            theta = Sums.of(pdf, k).solutions(p0)
            yield pd.DataFrame({f"_k_{c}": pdf[c] for c in names} | {"_n": pdf["n"]} | {t: theta[:, i] for i, t in enumerate(thetas)})

    def rows(pdfs):
        for pdf in pdfs:
            if table is not None:
                at, s = pdf[thetas].to_numpy(float), Sums.of(pdf, k)
                again = s.solutions(at)  # what rounding left
                yield table(pdf, s, np.where(np.isfinite(again).all(1)[:, None], again, at))[columns]
                continue
            made = []
            for r in pdf.to_dict("records"):
                theta = np.array([r[t] for t in thetas], float)
                s = normal.unpacked(r, theta)
                again = solve.linear_solution(s) if s.n >= k and s.usable else theta  # what rounding left
                s.theta = again if np.isfinite(again).all() else theta
                made.append(row(tuple(r[c] for c in names), s))
            yield pd.DataFrame(made, columns=columns)

    fields = ", ".join([f"`_k_{c}` {t}" for c, t in kinds.items()] + ["_n long"] + [f"{t} double" for t in thetas])
    first = written(sums(pts, p0, keys).mapInPandas(solutions, fields), "key-solutions")
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in names]
    if first.count() <= FEW:
        joined = pts.join(F.broadcast(first), on)
    else:  # keys of many rows, at most rows / GROUP_ROWS, are sent to every task; rows of others meet their key's
        large, small = first.filter(F.col("_n") > GROUP_ROWS), first.filter(F.col("_n") <= GROUP_ROWS)
        rest = pts.join(F.broadcast(large), on, "left_anti")
        joined = pts.join(F.broadcast(large), on).unionByName(rest.join(small, on))
    at = sums(joined, [F.col(t) for t in thetas], [*names, *thetas])
    return at.mapInPandas(rows, schema)


def hierarchical_fit(df: DataFrame, model, x, y: str, keys: list, sets="rollup", p0=None, sigma: str | None = None, absolute_sigma: bool = False, nan_policy: str = "omit") -> DataFrame:
    """keys, level, n, status, success, cost, nfev, params, stderr, error: a fit at every level of keys.

    sets: "rollup", "cube", or lists of keys. Sums are additive, so one scan feeds all levels: rows are expanded once per
    level, added up where they are, and each sum is solved. A key that a level leaves out is null there, and
    its bit in `level` (the grouping id) is 1, which tells it from a null in the data. For models linear in their
    parameters and without bounds. p0: where sums are taken; the nearer to the solutions, the less rounding.
    """
    model = named(model)
    if not model.linear or model.expr is None or np.isfinite(np.concatenate(model.limits())).any():
        raise ValueError("levels share sums only for models that are linear in their parameters and unbounded")
    pts = frame.points(df, frame.Roles.of(x, y, model.variables, sigma=sigma, keys=tuple(keys)), nan_policy)
    k = len(model.params)
    at = np.zeros(k) if p0 is None else np.asarray(p0, float)
    by = pts.rollup(*keys) if sets == "rollup" else pts.cube(*keys) if sets == "cube" else pts.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in keys))
    sums = by.agg(F.grouping_id().cast("long").alias("level"), *normal.aggregates(normal.terms(model, at)))
    kinds = {c: t for c, t in pts.dtypes if c in keys} | {"level": "long"}
    schema = result_schema(kinds)
    columns = [c.split()[0].strip("`") for c in schema.split(", ")]

    def rows(pdfs):
        for pdf in pdfs:
            made = []
            for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                s = normal.unpacked(r, at)
                if s.n >= k and s.usable:
                    theta = solve.linear_solution(s)
                    step = theta - at
                    drop = s.g @ step + step @ s.a @ step / 2
                    s = normal.State(theta, max(s.cost + drop, 0.0), s.g + s.a @ step, s.a, s.n, s.bad, max(s.ssr + 2 * drop, 0.0))
                made.append(row_of(tuple(r[c] for c in kinds), *outcome_of(s, absolute_sigma)))
            yield pd.DataFrame(made, columns=columns)

    return sums.mapInPandas(rows, schema)
