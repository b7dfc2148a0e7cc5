"""Fits with many parameters, of which each row touches a few.

A model is a sum of terms. A term is a formula whose parameters exist once per member: per value of a column
(levels), per interval of a variable (local), or once (shared). Rows know the members they touch before the fit
starts: levels by a join on the value, intervals by a join on the cells of a grid, so a row's work is that of its
own members. Parameters are a vector on the driver; J is never stored, and no k x k array exists.

method "cg": the step is found by conjugate gradients cut at the trust radius, each product J'J v one job of k
sums. method "blocks": J'J is summed as cells (i, j) of parameters that some row touches together, by a
shuffle, and factored member by member, in an order that leaves few cells to fill. "auto" takes blocks if only
intervals, or one set of levels beside shared terms, are there, since these fill little; else cg.

Where residuals are linear in the parameters and many rows touch the same levels, these rows are replaced by their
triangle once (folded): it has the same sums at any parameters, so that steps pass over members and not over rows.

Of such residuals, without bounds, the largest set of levels is solved for apart once it has more parameters than the
driver should hold: the rows of each of its members lie together, sums and products are those of rows less their
projection onto the member's own slopes, and only the other parameters are a vector on the driver. With these found,
each member's parameters follow from its rows, in its task, and are a table.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.losses import loss
from . import frame, solve
from .storage import written

BROADCAST = 500_000  # members up to which their table is sent to all tasks; beyond, rows and members are shuffled
FOLDED = 50_000  # different rows up to which none are folded
HELD = 100_000  # parameters of one set of levels up to which they are on the driver
_COMPARED = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "string", "date")  # keys that Arrow compares
_EPS = float(np.finfo(float).eps)
_FLAT = 1e-13  # curvature along a direction, beside 1 along each parameter, that is rounding


@dataclass(frozen=True)
class Term:
    """Text over its own parameters and the variables; one of by (a column) and low, high (of variable `along`), or
    neither for one shared member."""

    name: str
    text: str
    by: str | None = None
    along: str | None = None
    low: tuple = ()
    high: tuple = ()


def levels(name: str, text: str, by: str) -> Term:
    """One member per value of `by`; null is a value."""
    return Term(name, text, by=by)


def shared(name: str, text: str) -> Term:
    return Term(name, text)


def local(name: str, text: str, along: str, low, high) -> Term:
    """Member c counts where low[c] <= `along` <= high[c]; it may use its limits as variables low and high."""
    low, high = tuple(map(float, low)), tuple(map(float, high))
    if len(low) != len(high) or any(not a <= b for a, b in zip(low, high)):
        raise ValueError("every interval needs a lower end at or below its upper end")
    return Term(name, text, along=along, low=low, high=high)


@dataclass(frozen=True)
class Part:
    """A term in place: its expression, derivatives, members' keys and where its parameters begin."""

    term: Term
    expr: E.Expr
    params: tuple
    slopes: tuple
    keys: tuple
    start: int

    @property
    def size(self) -> int:
        return len(self.keys) * len(self.params)


def formula(term: Term, variables: tuple) -> tuple:
    """Expression, parameters and derivatives of a term."""
    e = E.parse(term.text, (*variables, *(("low", "high") if term.along else ())))
    params = tuple(E.names(e, "param"))
    return e, params, tuple(E.diff(e, p) for p in params)


def laid_out(terms: list, keys: list, variables: tuple) -> list:
    """Parts, those with the most members first, so that shared parameters come last."""
    out, start = [], 0
    for term, own in sorted(zip(terms, keys), key=lambda x: -len(x[1])):
        out.append(Part(term, *formula(term, variables), tuple(own), start))
        start += out[-1].size
    return out


def agree(one: pa.Array, two: pa.Array) -> np.ndarray:
    """Where keys are the same; null and NaN are values."""
    same = pc.or_(pc.fill_null(pc.equal(one, two), False), pc.and_(pc.is_null(one), pc.is_null(two)))
    if pa.types.is_floating(one.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(one), pc.is_nan(two)), False))
    return same.to_numpy(zero_copy_only=False)


def folded(pts: DataFrame, by: list, formulas: list, variables: tuple) -> DataFrame:
    """Rows of the columns `by`, v_<variable>, y and w, those that agree in `by` replaced by the triangle of their slopes
    and residuals at 0: columns `by`, s<term>_<parameter>, r and _n, the number of rows that each stands for.

    Rows are range-sorted by their keys, those of a frequent key dealt over several tasks by their hash. Each block of
    rows is folded alone; that a key has several triangles changes no sum. Rows that are not finite stay as they are.
    """
    names = [f"s{i}_{j}" for i, (_, params, _) in enumerate(formulas) for j in range(len(params))]
    width = len(names) + 1

    def run(batches):
        for b in batches:
            v, y, w, n = {x: b.column(f"v_{x}").to_numpy() for x in variables}, b.column("y").to_numpy(), b.column("w").to_numpy(), b.num_rows
            if not n:
                continue
            m, at = np.zeros((n, width)), 0
            with np.errstate(all="ignore"):
                for e, params, slopes in formulas:
                    m[:, -1] += E.to_numpy(e)(dict.fromkeys(params, np.float64(0.0)), v)
                    for s in slopes:
                        m[:, at] = w * E.to_numpy(s)({}, v)
                        at += 1
                m[:, -1] = w * (m[:, -1] - y)
            first, odd = np.ones(n, bool), ~np.isfinite(m).all(1)
            first[1:] = odd[1:] | odd[:-1]
            for c in by:
                first[1:] |= ~agree(b.column(c).slice(0, n - 1), b.column(c).slice(1))
            start = np.flatnonzero(first)
            size = np.diff(start, append=n)
            few = np.repeat(size <= width, size)
            rows, found, count = [np.flatnonzero(few)], [m[few]], [np.ones(int(few.sum()))]
            padded = 2 ** np.ceil(np.log2(size)).astype(int)
            for p in np.unique(padded[size > width]):  # groups of about the same size together, filled up with zeros
                own = (padded == p) & (size > width)
                grid = np.minimum(start[own][:, None] + np.arange(p), n - 1)
                block = np.where((np.arange(p) < size[own][:, None])[:, :, None], m[grid], 0.0)
                r = np.linalg.qr(block, mode="r")
                stands = np.zeros((len(r), width))
                stands[:, 0] = size[own]
                rows.append(np.repeat(start[own], width))
                found.append(r.reshape(-1, width))
                count.append(stands.ravel())
            at, out = pa.array(np.concatenate(rows)), np.concatenate(found)
            columns = [*(b.column(c).take(at) for c in by), *(pa.array(np.ascontiguousarray(c)) for c in out.T), pa.array(np.concatenate(count))]
            yield pa.RecordBatch.from_arrays(columns, [*by, *names, "r", "_n"])

    kinds, values = dict(pts.dtypes), [c for c in pts.columns if c not in by]
    dealt = pts.repartitionByRange(*(F.col(c) for c in by), F.xxhash64(*values)).sortWithinPartitions(*by)
    return dealt.mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in by] + [f"{c} double" for c in (*names, "r", "_n")]))


def whole(batches):
    """Batches of rows sorted by _key, cut anew so that none ends inside a member."""
    held: list = []
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        key = b.column("_key")
        at = np.flatnonzero(~agree(key.slice(0, n - 1), key.slice(1))) + 1
        goes_on = held and agree(held[-1].column("_key").slice(held[-1].num_rows - 1), key.slice(0, 1))[0]
        if not len(at) and goes_on:
            held.append(b)
            continue
        cut = int(at[-1]) if len(at) else 0
        if held or cut:
            yield pa.concat_batches([*held, b.slice(0, cut)])
        held = [b.slice(cut)]
    if held:
        yield pa.concat_batches(held)


def basis(batch, apart: int) -> tuple:
    """(first rows of members, their numbers of rows, columns, triangle): the slopes a0, a1, ... made orthonormal within
    each member. triangle[j] holds what column j had of those before it, and last its length, infinite where it
    depends on them; it is 0 there."""
    key = batch.column("_key")
    start = np.concatenate([[0], np.flatnonzero(~agree(key.slice(0, len(key) - 1), key.slice(1))) + 1])
    size = np.diff(start, append=len(key))
    columns, triangle = [], []
    for j in range(apart):
        v = batch.column(f"a{j}").to_numpy()
        length, had = np.sqrt(np.add.reduceat(v * v, start)), [0.0] * j
        for _ in (0, 1):  # twice, so that what is left is orthogonal to rounding
            for i, c in enumerate(columns):
                s = np.add.reduceat(c * v, start)
                v, had[i] = v - c * np.repeat(s, size), had[i] + s
        left = np.sqrt(np.add.reduceat(v * v, start))
        left = np.where(left > _FLAT * length, left, np.inf)
        columns.append(v / np.repeat(left, size))
        triangle.append((*had, left))
    return start, size, columns, triangle


def less(batch, apart: int, x: np.ndarray) -> np.ndarray:
    """A number per row, less its projection onto the slopes of the levels that are solved for apart."""
    if apart:
        start, size, columns, _ = basis(batch, apart)
        for c in (*columns, *columns):
            x = x - c * np.repeat(np.add.reduceat(c * x, start), size)
    return x


def touched(df: DataFrame, term: Term, x: str, out: str) -> tuple:
    """(df with column `out`, the numbers of the members that each row touches; keys of the members)."""
    spark = df.sparkSession
    if term.by is not None:
        kind = dict(df.dtypes)[term.by]
        found = df.select(term.by).distinct().orderBy(term.by)  # as many as parameters
        if kind in ("tinyint", "smallint", "int", "bigint", "string"):  # as arrays, since they may be many
            column = found.toArrow().column(0)
            keys = column.to_pylist()
            table = spark.createDataFrame(pa.table({"_key": column, "_member": np.arange(len(keys), dtype=np.int32)}), f"_key {kind}, _member int")
        else:
            keys = [r[0] for r in found.collect()]
            table = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"_key {kind}, _member int")
        table = F.broadcast(table) if len(keys) <= BROADCAST else table
        joined = df.join(table, F.col(term.by).eqNullSafe(F.col("_key")), "left")
        return joined.withColumn(out, F.array("_member")).drop("_key", "_member"), keys
    if term.along is None:
        return df.withColumn(out, F.array(F.lit(0))), [None]
    spans = np.array(term.high) - np.array(term.low)
    width = max(float(spans.mean()), 1e-300)  # so members fall in few cells each, all together in 3 a member at most
    cells: dict = {}
    for c, (a, b) in enumerate(zip(term.low, term.high)):
        for cell in range(int(np.floor(a / width)), int(np.floor(b / width)) + 1):
            cells.setdefault(cell, []).append((c, a, b))
    table = spark.createDataFrame(list(cells.items()), "_cell long, _near array<struct<c:int,a:double,b:double>>")
    table = F.broadcast(table) if len(term.low) <= BROADCAST else table
    v = F.col(x)
    joined = df.join(table, F.floor(v / width) == F.col("_cell"), "left")
    inside = F.transform(F.filter("_near", lambda m: (v >= m.a) & (v <= m.b)), lambda m: m.c)
    return joined.withColumn(out, F.coalesce(inside, F.array().cast("array<int>"))).drop("_cell", "_near"), list(zip(term.low, term.high))


@dataclass
class WideState:
    """Sums at theta; products and cells are made on demand, each by a job."""

    theta: np.ndarray
    cost: float
    g: np.ndarray
    diagonal: np.ndarray
    n: int
    bad: int
    ssr: float
    problem: object

    @property
    def usable(self) -> bool:
        return self.bad == 0 and np.isfinite(self.cost) and bool(np.isfinite(self.g).all() and np.isfinite(self.diagonal).all())

    def quadratic(self, d: np.ndarray, g: np.ndarray, extra: np.ndarray):
        return Blocks(self, d, g, extra) if self.problem.method == "blocks" else Krylov(self, d, g, extra)


def add(total: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """total[at] += values, repeats included, at a cost of the values and not of the total."""
    if len(total) <= len(at):
        total += np.bincount(at, values, len(total))
    else:
        np.add.at(total, at, values)


class WideProblem:
    """Evaluates a sum of parts on rows with v_<variable>, y, w, _m (how often a row counts) and t<i>, the members
    touched of part i; or on folded rows, with s<i>_<parameter>, r and _n in place of the first four. Levels that are
    solved for apart are none of the parts: rows, sorted, have their key _key and slopes a0, a1, ... (`apart` of them)."""

    def __init__(self, pts: DataFrame, parts: list, variables: tuple, which="linear", scale: float = 1.0, method: str = "cg", forcing: float | None = None, apart: int = 0):
        self.pts, self.parts, self.variables, self.which, self.scale, self.method = pts.persist(), parts, variables, which, scale, method
        self.k, self.calls, self.products, self.forcing = sum(p.size for p in parts), 0, 0, forcing
        self.folded, self.often = "_n" in pts.columns, "_n" if "_n" in pts.columns else "_m"
        self.apart, self.batches = apart, whole if apart else iter

    def close(self) -> None:
        self.pts.unpersist()

    def kernel(self, apart: int = 0):
        """What tasks need: batch -> (r, cost, gradient weight, Hessian weight, row, position, slope) of a block; weights hold _m.
        apart: r is less its projection onto so many slopes of the levels solved for apart."""
        parts, variables, which, scale = [replace(p, keys=()) for p in self.parts], self.variables, self.which, self.scale  # keys may be many

        def triangles(theta: np.ndarray, batch) -> tuple:
            r, places, slopes = batch.column("r").to_numpy().copy(), [np.zeros(0, np.int64)], [np.zeros(0)]
            for i, p in enumerate(parts):
                first = p.start + batch.column(f"t{i}").flatten().to_numpy().astype(np.int64) * len(p.params)
                for j in range(len(p.params)):
                    places.append(first + j)
                    slopes.append(batch.column(f"s{i}_{j}").to_numpy())
                    r += slopes[-1] * theta[places[-1]]
            r, one = less(batch, apart, r), np.ones(len(r))
            return r, 0.5 * r * r, one, one, np.tile(np.arange(len(r)), len(places) - 1), np.concatenate(places), np.concatenate(slopes)

        if self.folded:
            return triangles

        def block(theta: np.ndarray, batch) -> tuple:
            v = {x: batch.column(f"v_{x}").to_numpy() for x in variables}
            y, w, m = (batch.column(c).to_numpy() for c in ("y", "w", "_m"))
            f, rows, places, slopes = np.zeros(len(y)), [], [], []
            with np.errstate(all="ignore"):
                for i, p in enumerate(parts):
                    lists = batch.column(f"t{i}")
                    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
                    member = lists.flatten().to_numpy().astype(np.int64)
                    own = {x: a[row] for x, a in v.items()}
                    if p.term.along:
                        own |= {"low": np.array(p.term.low)[member], "high": np.array(p.term.high)[member]}
                    at = p.start + member * len(p.params)
                    given = {name: theta[at + j] for j, name in enumerate(p.params)}
                    f += np.bincount(row, np.broadcast_to(E.to_numpy(p.expr)(given, own), row.shape), len(y))
                    for j, s in enumerate(p.slopes):
                        rows.append(row)
                        places.append(at + j)
                        slopes.append(np.broadcast_to(E.to_numpy(s)(given, own), row.shape))
                r = w * (f - y)
                row = np.concatenate(rows)
                slope = np.concatenate(slopes) * w[row]
                if which == "linear":
                    return r, 0.5 * m * r * r, m, m, row, np.concatenate(places), slope
                z = (r / scale) ** 2
                rho, first, second = (np.broadcast_to(E.to_numpy(e)({}, {"z": z}), z.shape) for e in loss(which))
                return r, 0.5 * scale * scale * m * rho, m * first, m * np.maximum(first + 2 * second * z, _EPS), row, np.concatenate(places), slope

        return block

    def __call__(self, theta) -> WideState:
        theta, k, block, often, cut = np.asarray(theta, float), self.k, self.kernel(self.apart), self.often, self.batches
        self.calls += 1

        def run(batches):
            total = np.zeros(4 + 2 * k)
            for b in cut(batches):
                r, cost, first, hess, row, at, slope = block(theta, b)
                m = b.column(often).to_numpy()
                total[:4] += [m.sum(), m[~np.isfinite(r)].sum(), cost.sum(), r @ r if often == "_n" else (m * r) @ r]
                add(total[4 : 4 + k], at, slope * (first * r)[row])
                add(total[4 + k :], at, slope * slope * hess[row])
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["i", "s"])

        t = self.gathered(run, 4 + 2 * k)
        return WideState(theta, float(t[2]), t[4 : 4 + k], t[4 + k :], int(t[0]), int(t[1]), float(t[3]), self)

    def gathered(self, run, size: int) -> np.ndarray:
        """Sums by place: what tasks touched, added up by Spark."""
        out = np.zeros(size)
        rows = self.pts.mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
        out[rows.column("i").to_numpy()] = rows.column("s").to_numpy()
        return out

    def product(self, theta: np.ndarray, v: np.ndarray) -> np.ndarray:
        """J'J v, in one job."""
        k, block, apart, cut = self.k, self.kernel(), self.apart, self.batches
        theta = v if self.folded else theta  # of which slopes of triangles do not depend: one vector less to send
        self.products += 1

        def run(batches):
            total = np.zeros(k)
            for b in cut(batches):
                r, _, _, hess, row, at, slope = block(theta, b)
                along = less(b, apart, np.bincount(row, slope * v[at], len(r)) * hess)
                add(total, at, slope * along[row])
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["i", "s"])

        return self.gathered(run, k)

    def members(self, theta: np.ndarray, start: np.ndarray, names: list, kind: str) -> DataFrame:
        """_key and the parameters of each member of the levels solved for apart, with all others at theta. What its
        rows do not tell apart stays at its start."""
        block, apart = self.kernel(), self.apart

        def run(batches):
            for b in whole(batches):
                r = block(theta, b)[0] + sum(b.column(f"a{j}").to_numpy() * start[j] for j in range(apart))
                first, size, columns, triangle = basis(b, apart)
                along = [np.zeros(len(first)) for _ in columns]
                for _ in (0, 1):
                    for j, c in enumerate(columns):
                        s = np.add.reduceat(c * r, first)
                        r, along[j] = r - c * np.repeat(s, size), along[j] - s
                moved: list = [None] * apart
                for j in reversed(range(apart)):
                    moved[j] = (along[j] - sum(triangle[i][j] * moved[i] for i in range(j + 1, apart))) / triangle[j][-1]
                yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(first)), *(pa.array(m + start[j]) for j, m in enumerate(moved))], ["_key", *names])

        return self.pts.mapInArrow(run, ", ".join([f"_key {kind}", *(f"{c} double" for c in names)]))

    def cells(self, theta: np.ndarray) -> tuple:
        """(i, j, sum) of J'J for i <= j, of pairs that some row touches together."""
        k, block = self.k, self.kernel()

        def run(batches):
            keys, sums = np.zeros(0, np.int64), np.zeros(0)
            for b in batches:
                r, _, _, hess, row, at, slope = block(theta, b)
                order = np.lexsort((at, row))
                row, at, slope = row[order], at[order], slope[order] * np.sqrt(hess)[row[order]]
                first, each = np.flatnonzero(np.diff(row, prepend=-1)), np.bincount(row, minlength=len(r))
                each = each[each > 0]
                found_k, found_s = [keys], [sums]
                for e in np.unique(each):  # rows that touch equally many
                    grid = first[each == e][:, None] + np.arange(e)
                    p, s = at[grid], slope[grid]
                    i, j = np.triu_indices(e)
                    found_k.append((p[:, i] * k + p[:, j]).ravel())
                    found_s.append((s[:, i] * s[:, j]).ravel())
                keys, back = np.unique(np.concatenate(found_k), return_inverse=True)
                sums = np.bincount(back, np.concatenate(found_s), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys // k), pa.array(keys % k), pa.array(sums)], ["i", "j", "s"])

        t = self.pts.mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
        return tuple(t.column(c).to_numpy() for c in ("i", "j", "s"))

    def blocks(self) -> np.ndarray:
        """The member, counted over all parts, that each parameter belongs to."""
        out, n = [], 0
        for p in self.parts:
            out.append(n + np.repeat(np.arange(len(p.keys)), len(p.params)))
            n += len(p.keys)
        return np.concatenate(out)


class Krylov:
    """Steps by conjugate gradients, cut where they leave the trust radius. A smaller radius cuts the same path."""

    def __init__(self, state: WideState, d: np.ndarray, g: np.ndarray, extra: np.ndarray):
        self.state, self.d, self.g, self.extra = state, d, g, extra
        self.path: list = []  # (s, as, direction, a direction) before each step
        self.end = None

    def times(self, s: np.ndarray) -> np.ndarray:
        return self.d * self.state.problem.product(self.state.theta, self.d * s) + self.extra * s

    def step(self, radius: float) -> tuple:
        for s, bent, p, ap in self.path:
            if np.linalg.norm(s + self.reach(s, p, ap) * p) >= radius:
                return self.cut(s, bent, p, ap, radius)
        return self.end if self.end is not None else self.extended(radius)

    def reach(self, s, p, ap) -> float:
        """How far along p the quadratic falls; without end if it does not curve up."""
        curve = p @ ap
        return -(self.g @ p + s @ ap) / curve if curve > 0 else np.inf

    @staticmethod
    def cut(s, bent, p, ap, radius: float) -> tuple:
        a, b, c = p @ p, 2 * s @ p, s @ s - radius * radius
        t = (-b + np.sqrt(max(b * b - 4 * a * c, 0.0))) / (2 * a)
        return s + t * p, bent + t * ap

    def extended(self, radius: float) -> tuple:
        goal = np.linalg.norm(self.g) * (self.state.problem.forcing or min(0.1, np.sqrt(np.linalg.norm(self.g))))
        s, bent, r = np.zeros_like(self.g), np.zeros_like(self.g), self.g.copy()
        p = -r
        while np.linalg.norm(r) > goal and len(self.path) < 2 * len(self.g) + 10:
            ap = self.times(p)
            if p @ ap <= _FLAT * (p @ p) and not np.isfinite(radius):
                break  # parameters that the rows do not tell apart: what is left of the gradient along p is rounding
            self.path.append((s, bent, p, ap))
            t = self.reach(s, p, ap)
            if not np.isfinite(t) or np.linalg.norm(s + t * p) >= radius:
                return self.cut(s, bent, p, ap, radius if np.isfinite(radius) else np.linalg.norm(s) + 1.0)
            s, bent = s + t * p, bent + t * ap
            old, r = r, self.g + bent
            p = -r + (r @ r) / (old @ old) * p
        self.end = s, bent
        return self.end


class Factor:
    """Cholesky factor of a symmetric matrix of blocks, eliminated in the order of their numbers."""

    def __init__(self, of: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray, diagonal: np.ndarray):
        self.places = np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1)
        within = np.concatenate([np.arange(len(p)) for p in self.places])
        rows: list = [{} for _ in self.places]
        for n, p in enumerate(self.places):
            rows[n][n] = np.diag(diagonal[p])
        for a, b, v in zip(i.tolist(), j.tolist(), s.tolist()):
            x, y = int(of[a]), int(of[b])
            if y not in rows[x]:
                rows[x][y] = np.zeros((len(self.places[x]), len(self.places[y])))
            rows[x][y][within[a], within[b]] += v
            if x == y and a != b:
                rows[x][y][within[b], within[a]] += v
        self.low, self.right = [], []
        for n, row in enumerate(rows):
            low = np.linalg.cholesky(row.pop(n))
            right = {m: np.linalg.solve(low, block) for m, block in row.items()}
            order = sorted(right)
            for at, m in enumerate(order):
                for o in order[at:]:
                    change = right[m].T @ right[o]
                    rows[m][o] = rows[m][o] - change if o in rows[m] else -change
            self.low.append(low)
            self.right.append(right)
            rows[n] = {}

    def solve(self, b: np.ndarray) -> np.ndarray:
        x = b.astype(float).copy()
        for n, p in enumerate(self.places):
            x[p] = np.linalg.solve(self.low[n], x[p])
            for m, block in self.right[n].items():
                x[self.places[m]] -= block.T @ x[p]
        for n in range(len(self.places) - 1, -1, -1):
            p = self.places[n]
            for m, block in self.right[n].items():
                x[p] -= block @ x[self.places[m]]
            x[p] = np.linalg.solve(self.low[n].T, x[p])
        return x


class Blocks:
    """Steps through a factor of the cells of J'J, with a multiple of 1 added where they leave the trust radius."""

    def __init__(self, state: WideState, d: np.ndarray, g: np.ndarray, extra: np.ndarray):
        self.g, problem = g, state.problem
        i, j, s = problem.cells(state.theta)
        self.i, self.j, self.s, self.of = i, j, s * d[i] * d[j], problem.blocks()
        self.extra = extra + (state.diagonal <= 0)  # what no row touches stays where it is

    def times(self, x: np.ndarray) -> np.ndarray:
        out = self.extra * x + np.bincount(self.i, self.s * x[self.j], len(x))
        off = self.i != self.j
        return out + np.bincount(self.j[off], self.s[off] * x[self.i[off]], len(x))

    def factor(self, mu: float) -> Factor:
        return Factor(self.of, self.i, self.j, self.s, self.extra + mu)

    def step(self, radius: float) -> tuple:
        mu, least = 0.0, 0.0
        for _ in range(60):
            try:
                f = self.factor(mu)
                s = f.solve(-self.g)
            except np.linalg.LinAlgError:
                s = np.full_like(self.g, np.nan)
            if not np.isfinite(s).all():
                mu = least = max(10 * mu, 1e-12)
                continue
            n = np.linalg.norm(s)
            if n <= radius * 1.001 and (mu <= least or n >= 0.9 * radius):
                break
            slope = s @ f.solve(s)
            mu = max(least, mu + (n - radius) / radius * n * n / max(slope, 1e-300))
        n = np.linalg.norm(s)
        s = s * min(1.0, radius / n) if n > 0 else s
        return s, self.times(s)


@dataclass
class WideFit:
    theta: np.ndarray
    outcome: solve.Outcome
    parts: list
    problem: WideProblem
    apart: tuple | None = None  # (term, parameters, table) of the levels that are not in theta: a row per member, _key and p0, p1, ...

    def member(self, name: str) -> dict:
        """key -> parameters of a term."""
        if self.apart and self.apart[0].name == name:
            return {r[0]: list(r[1:]) for r in self.apart[2].collect()}
        p = next(p for p in self.parts if p.term.name == name)
        return dict(zip(p.keys, self.theta[p.start : p.start + p.size].reshape(len(p.keys), -1).tolist()))

    def table(self) -> DataFrame:
        """term, member (its key as text, its number for intervals), param, value."""
        tables = []
        for p in self.parts:
            labels, n = [str(c) if p.term.along else None if key is None else str(key) for c, key in enumerate(p.keys)], len(p.params)
            columns = [pa.repeat(p.term.name, p.size), pa.array(labels, pa.string()).take(np.repeat(np.arange(len(labels)), n)), pa.array(list(p.params) * len(labels), pa.string()), pa.array(self.theta[p.start : p.start + p.size])]
            tables.append(pa.table(columns, ["term", "member", "param", "value"]))
        spark, shape = self.problem.pts.sparkSession, "term string, member string, param string, value double"
        found = spark.createDataFrame(pa.concat_tables(tables), shape) if tables else spark.createDataFrame([], shape)
        if not self.apart:
            return found
        term, params, members = self.apart
        key = F.col("_key")
        label = F.when(key.isNotNull(), F.udf(lambda k: str(k))(key)) if dict(members.dtypes)["_key"] in ("float", "double", "boolean") else key.cast("string")  # text as above
        each = F.inline(F.array(*(F.struct(F.lit(p).alias("param"), F.col(f"p{j}").alias("value")) for j, p in enumerate(params))))
        return members.select(F.lit(term.name).alias("term"), label.alias("member"), each).unionByName(found)

    def stderr(self, absolute: bool = False) -> np.ndarray:
        """Standard errors, from the factor of the cells; a solve per parameter."""
        if self.apart:
            raise ValueError("there are too many levels for a solve per parameter")
        s = self.outcome.state
        norms = np.where(s.diagonal > 0, np.sqrt(np.maximum(s.diagonal, 0)), 1.0)
        f = Blocks(s, 1 / norms, s.g / norms, np.zeros(len(norms))).factor(0.0)
        out = np.empty(len(norms))
        for i in range(len(norms)):
            e = np.zeros(len(norms))
            e[i] = 1.0
            out[i] = np.sqrt(f.solve(e)[i]) / norms[i]
        return out if absolute else out * np.sqrt(s.ssr / (s.n - len(out))) if s.n > len(out) else np.full(len(out), np.inf)


def largest(terms: list, formulas: list, counts: tuple, p0: dict | None) -> int | None:
    """The set of levels with the most parameters, if these are more than the driver should hold and start alike; counts: how
    many members each set of levels has, about."""
    sizes = dict(zip([i for i, t in enumerate(terms) if t.by is not None], counts))
    sizes = {i: n * len(formulas[i][1]) for i, n in sizes.items() if formulas[i][1] and np.ndim((p0 or {}).get(terms[i].name, 0.0)) < 2}
    most = max(sizes, key=sizes.get, default=None)
    return most if most is not None and sizes[most] > HELD else None


def level(key: Column, kind: str) -> Column:
    """0 for -0, which is the same level, as in any grouping."""
    return F.when(key == 0, F.lit(0.0).cast(kind)).otherwise(key) if kind in ("float", "double") else key


def alone(state: WideState) -> solve.Outcome:
    """The fit of levels beside no other parameters: nothing is left to search."""
    if not state.usable:
        raise ValueError("the model is not finite at the starting values")
    return solve.Outcome(state.theta, state, 1, 1, 0, 0.0)


def wide_fit(
    df: DataFrame, terms: list, x, y: str, variables: tuple = ("x",), p0: dict | None = None, bounds: dict | None = None, sigma: str | None = None, loss: str = "linear", f_scale: float = 1.0,
    nan_policy: str = "raise", method: str = "auto", mask: str | None = None, **options,
) -> WideFit:
    """Least squares of y on the sum of terms. p0 and bounds: by term name, values for its parameters, or a row per
    member; parameters start at 0 without. options: ftol, xtol, gtol, max_nfev, callback of solve.minimise.

    Rows of no member count with a model value of 0. A member that no row of a local term touches keeps its start.
    Where levels are solved for apart, theta, the outcome and callbacks have the other parameters, found by "cg".
    nan_policy as in curve_fit; an empty table raises ValueError.
    """
    if method not in ("auto", "cg", "blocks"):
        raise ValueError(f"unknown method {method}")
    roles = frame.Roles.of(x, y, tuple(variables), sigma=sigma, mask=mask)
    by = [(f"_by{i}", t.by) for i, t in enumerate(terms) if t.by is not None]
    for name, column in by:
        df = df.withColumn(name, F.col(column))
    pts = frame.points(df, roles, nan_policy, extra=tuple(n for n, _ in by)).drop("ord")
    own, formulas = [n for n, _ in by], [formula(t, tuple(variables)) for t in terms]
    linear = loss == "linear" and not any(E.names(s, "param") for _, _, slopes in formulas for s in slopes)
    seen = frame.variety(pts, pts.columns, own, *([c] for c in own if len(own) > 1)) if own else (*frame.variety(pts, pts.columns), 1)
    rows, distinct, groups = seen[:3]
    alike = 4 * groups * (1 + sum(len(params) for _, params, _ in formulas)) <= rows  # triangles are a quarter of the rows at most
    kinds = dict(pts.dtypes)
    plain = linear and own and all(kinds[c] in _COMPARED for c in own) and not any(t.along for t in terms)
    apart = largest(terms, formulas, seen[3:] or seen[2:], p0) if plain and bounds is None else None
    fold = apart is not None or plain and alike and 4 * distinct > rows and distinct > FOLDED
    pts = base = folded(pts, own, formulas, tuple(variables)) if fold else frame.repeated(pts, seen[:2])
    if fold and (apart is None or len(own) > 1):  # looked at more than once
        base.persist()
    keys, named, places = [], [], []
    for i, t in enumerate(terms):
        if i == apart:
            continue
        inner = Term(t.name, t.text, f"_by{i}" if t.by is not None else None, t.along, t.low, t.high)
        pts, found = touched(pts, inner, f"v_{t.along}" if t.along else "", f"m{i}")
        keys.append(found)
        named.append(t)
        places.append(i)
    parts = laid_out(named, keys, tuple(variables))
    order = [places[named.index(p.term)] for p in parts]
    slopes = [F.col(f"s{i}_{j}").alias(f"s{at}_{j}") for at, i in enumerate(order) for j in range(len(parts[at].params))]
    values = [*slopes, "r", "_n"] if fold else [*(f"v_{v}" for v in variables), "y", "w", "_m"]
    away = [] if apart is None else [level(F.col(f"_by{apart}"), kinds[f"_by{apart}"]).alias("_key"), *(F.col(f"s{apart}_{j}").alias(f"a{j}") for j in range(len(formulas[apart][1])))]
    pts = pts.select(*away, *values, *(F.col(f"m{i}").alias(f"t{at}") for at, i in enumerate(order)))
    if away:
        pts, method = pts.repartition("_key").sortWithinPartitions("_key"), "cg"
    if method == "auto":
        many = [p for p in parts if len(p.keys) > 1]
        method = "blocks" if len(many) <= 1 or all(p.term.along for p in many) else "cg"
    lo, hi, theta = (np.full(sum(p.size for p in parts), v) for v in (-np.inf, np.inf, 0.0))
    for p in parts:
        place, shape = slice(p.start, p.start + p.size), (len(p.keys), len(p.params))
        fill = lambda v: np.broadcast_to(np.asarray(v, float), shape).ravel()  # noqa: E731, B023
        if p0 and p.term.name in p0:
            theta[place] = fill(p0[p.term.name])
        if bounds and p.term.name in bounds:
            lo[place], hi[place] = (fill(b) for b in bounds[p.term.name])
    problem = WideProblem(pts, parts, tuple(variables), loss, f_scale, method, 1e-9 if linear else None, len(away[1:]))
    members = None
    try:
        if not away and not len(theta):
            raise ValueError("there are no rows")
        free = bounds is None
        out = solve.minimise(problem, theta, None if free else lo, None if free else hi, linear=linear, **options) if len(theta) else alone(problem(theta))
        if away:
            t, params = terms[apart], formulas[apart][1]
            start = np.broadcast_to(np.asarray((p0 or {}).get(t.name, 0.0), float), len(params))
            members = t, params, written(problem.members(out.theta, start, [f"p{j}" for j in range(len(params))], kinds[f"_by{apart}"]), "levels")
    finally:
        problem.close()
        base.unpersist()
    return WideFit(out.theta, out, parts, problem, members)
