"""Fits that follow a stream: additive sums per micro-batch or in Spark's state store, recursive fits per key, and
event-time windows of linear fits."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import named
from ..operators import frame, normal
from ..operators.solve import linear_solution, minimise


class Incremental:
    """Running J'J, J'r, SSR and n at a fixed linearisation point; solve() gives the Gauss-Newton estimate.

    For a model that is linear in its parameters that estimate is the fit of all rows seen. Batches are
    keyed by their id, so a batch that is delivered again after a restart counts once. With start() the sums
    are written beside the stream's checkpoint before a batch is done, and a restarted driver begins with them.
    """

    def __init__(self, model, x, y: str, theta=None, sigma: str | None = None):
        self.model = named(model)
        self.roles = frame.Roles.of(x, y, self.model.variables, sigma=sigma)
        k = len(self.model.params)
        self.theta = np.zeros(k) if theta is None else np.asarray(theta, float)
        self.a, self.g, self.ssr, self.n, self.seen = np.zeros((k, k)), np.zeros(k), 0.0, 0, -1
        self.folder: str | None = None

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch."""
        if batch_id <= self.seen:
            return
        pts = frame.points(batch, self.roles, "omit")
        row = pts.agg(*normal.aggregates(normal.terms(self.model, self.theta))).first()
        if row.n:
            s = normal.unpacked(row, self.theta)
            self.a += s.a
            self.g += s.g
            self.ssr += s.ssr
            self.n += s.n
        self.seen = batch_id
        if self.folder:
            self.save(batch.sparkSession)

    def solve(self) -> np.ndarray:
        d = np.sqrt(np.maximum(np.diag(self.a), 1e-300))
        return self.theta - np.linalg.solve(self.a / np.outer(d, d), self.g / d) / d

    def covariance(self, absolute: bool = False) -> np.ndarray:
        """Covariance of solve(): (J'J)^-1, times SSR / (n - k) at the solution unless sigma is absolute."""
        step = self.solve() - self.theta
        ssr = self.ssr + 2 * self.g @ step + step @ self.a @ step
        k = len(self.theta)
        if self.n <= k and not absolute:
            return np.full((k, k), np.inf)
        return np.linalg.pinv(self.a, hermitian=True) * (1.0 if absolute else max(ssr, 0.0) / (self.n - k))

    def state(self) -> str:
        return json.dumps({"theta": self.theta.tolist(), "a": self.a.tolist(), "g": self.g.tolist(), "ssr": self.ssr, "n": self.n, "seen": self.seen})

    def restore(self, text: str) -> None:
        s = json.loads(text)
        self.theta, self.a, self.g = (np.array(s[k], float) for k in ("theta", "a", "g"))
        self.ssr, self.n, self.seen = s["ssr"], s["n"], s["seen"]

    def save(self, spark: SparkSession) -> None:
        """One of two files in turn, so that a driver lost while it writes leaves the other."""
        spark.createDataFrame([(self.state(),)], "state string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/sums-{self.seen % 2}")

    def load(self, spark: SparkSession) -> None:
        """The later of the two states that are there; none leaves everything at 0."""
        found = []
        for i in (0, 1):
            try:
                found += [r.value for r in spark.read.text(f"{self.folder}/sums-{i}").collect()]
            except AnalysisException:  # not written yet
                continue
        if found:
            self.restore(max(found, key=lambda text: json.loads(text)["seen"]))

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        self.folder = f"{checkpoint.rstrip('/')}-sums"
        self.load(stream.sparkSession)
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_linear(events: DataFrame, ts: str, x: str, y: str, width: str, late: str | None = None, slide: str | None = None, keys: tuple = ()) -> DataFrame:
    """slope, intercept and n of y ~ x per event-time window (and keys); batch or stream, with a watermark for late rows."""
    if late:
        events = events.withWatermark(ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(w, *keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


# ---- sums in Spark's state store ----


def stream_fits(stream: DataFrame, model, x, y: str, keys: list, p0=None, sigma: str | None = None) -> DataFrame:
    """keys, n, success, params, ssr of every key, over all rows that a stream has brought so far. Use output mode update
    (keys that a batch touched) or complete.

    A model that is linear in its parameters is a streaming aggregate: its sums are added up before the shuffle and kept
    by key in Spark's state store, under the query's checkpoint, so a driver that is restarted goes on with them and
    no row counts twice. Its solution is worked out from them in each batch. Others go through recursive_fits.
    Rows that are not finite are left out. On a batch table it gives the fits of all rows.
    """
    model = named(model)
    if not model.linear or model.expr is None or np.isfinite(np.concatenate(model.limits())).any():
        return recursive_fits(stream, model, x, y, keys, p0, sigma)
    k = len(model.params)
    at = np.zeros(k) if p0 is None else np.asarray(p0, float)
    pts = frame.points(stream, frame.Roles.of(x, y, model.variables, sigma=sigma, keys=tuple(keys)), "omit")
    sums = pts.groupBy(*keys).agg(*normal.aggregates(normal.terms(model, at)))
    kinds = {c: t for c, t in pts.dtypes if c in keys}
    schema = ", ".join([*(f"`{c}` {t}" for c, t in kinds.items()), FITTED])

    def solve_rows(pdfs):
        for pdf in pdfs:
            rows = []
            for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                s = normal.unpacked(r, at)
                good = s.n >= k and s.usable
                theta = linear_solution(s) if good else at
                step = theta - at
                rows.append((*(r[c] for c in kinds), s.n, good, theta.tolist() if good else None, max(s.ssr + 2 * s.g @ step + step @ s.a @ step, 0.0)))
            yield pd.DataFrame(rows, columns=[*kinds, *(f.split()[0] for f in FITTED.split(", "))])

    return sums.mapInPandas(solve_rows, schema)


FITTED = "n long, success boolean, params array<double>, ssr double"


def recursive_fits(stream: DataFrame, model, x, y: str, keys: list, p0, sigma: str | None = None) -> DataFrame:
    """stream_fits for models that are not linear: keys, n, success, params, ssr after each batch, in update mode.

    State of a key, in Spark's state store: theta and the quadratic that the rows so far left, linearised at the estimate
    that their batch ended with. A batch is fitted beside that quadratic by the trust-region solver, and added to it. A
    key's rows of one batch pass through one task; ssr is that of the linearised residuals. Null keys are keys.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    model, start = named(model), np.asarray(p0, float)
    k = len(start)
    pts = frame.points(stream, frame.Roles.of(x, y, model.variables, sigma=sigma, keys=tuple(keys)), "omit").drop("ord")
    kinds = {c: t for c, t in pts.dtypes if c in keys}
    names = [*kinds, *(f.split()[0] for f in FITTED.split(", "))]

    def residuals(theta, pdf):
        r, j, *_ = normal.block_terms(model, theta, {v: pdf[f"v_{v}"].to_numpy(float) for v in model.variables}, pdf["y"].to_numpy(float), pdf["w"].to_numpy(float), "linear", 1.0)
        good = np.isfinite(r) & np.isfinite(j).all(1)
        return r[good], j[good]

    def update(key, parts, state):
        theta, a, b, c, n = start, np.zeros((k, k)), np.zeros(k), 0.0, 0
        if state.exists:
            flat, n = state.get
            flat = np.array(flat)
            theta, a, b, c = flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k : -1], flat[-1]
        parts = list(parts)

        def joined(t):
            """Rows of this batch beside the quadratic that the rows before left."""
            cost, g, h, rows = (t @ a @ t - 2 * b @ t + c) / 2, a @ t - b, a.copy(), n
            for p in parts:
                r, j = residuals(t, p)
                cost, g, h, rows = cost + r @ r / 2, g + j.T @ r, h + j.T @ j, rows + len(r)
            return normal.State(np.asarray(t, float), float(cost), g, h, rows, 0, 2 * float(cost))

        good = True
        try:
            theta = minimise(joined, theta).theta
        except (ValueError, np.linalg.LinAlgError):
            good = False
        for p in parts:
            r, j = residuals(theta, p)
            t = j @ theta - r
            a, b, c, n = a + j.T @ j, b + j.T @ t, c + float(t @ t), n + len(r)
        good = good and n >= k
        state.update((np.concatenate([theta, a.ravel(), b, [c]]).tolist(), int(n)))
        ssr = max(c - 2 * theta @ b + theta @ a @ theta, 0.0)
        yield pd.DataFrame([(*key, int(n), good, theta.tolist() if good else None, float(ssr))], columns=names)

    schema = ", ".join([*(f"`{c}` {t}" for c, t in kinds.items()), FITTED])
    return pts.groupBy(*keys).applyInPandasWithState(update, schema, "flat array<double>, n long", "update", GroupStateTimeout.NoTimeout)
