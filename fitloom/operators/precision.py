"""What to fit with: starting values by position, bounds from data, loss and tolerances from data quality."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frame
from .storage import written

FEW = 200_000  # series up to which their ranges are sent to every task


def generic_start(s: dict, k: int) -> list:
    """By position: range of y, 1 / range of x, mean of y, mean of x, then ones. s: fitloom.functions.models.summary."""
    span = s["x1"] - s["x0"]
    return ([s["y1"] - s["y0"] or 1.0, 1 / span if span else 1.0, s["ym"], s["xm"]] + [1.0] * k)[:k]


def infer_bounds(p0, s: dict, factor: float = 10.0, positive: tuple = ()) -> tuple:
    """Around each starting value: factor times its size, or the data's ranges where that is more; a
    parameter in `positive` (by index) does not go below 0."""
    p0 = np.asarray(p0, float)
    reach = np.maximum(np.abs(p0) * factor, max(abs(s["y1"] - s["y0"]), abs(s["x1"] - s["x0"]), 1e-12))
    lo, hi = p0 - reach, p0 + reach
    for i in positive:
        lo[i] = max(0.0, lo[i])
    return lo, hi


def merge_bounds(user: tuple, inferred: tuple) -> tuple:
    """The user's finite bounds, inferred ones elsewhere; where they cross, the user's side wins."""
    ulo, uhi, ilo, ihi = (np.asarray(b, float) for b in (*user, *inferred))
    lo, hi = np.where(np.isfinite(ulo), ulo, ilo), np.where(np.isfinite(uhi), uhi, ihi)
    cross = lo >= hi
    lo = np.where(cross & np.isfinite(uhi) & ~np.isfinite(ulo), -np.inf, lo)
    hi = np.where(cross & np.isfinite(ulo) & ~np.isfinite(uhi), np.inf, hi)
    return lo, hi


class Normalizer:
    """Parameters in units of their bounds' width or of their starting size."""

    def __init__(self, p0, lo, hi, how: str = "auto"):
        p0, lo, hi = (np.asarray(v, float) for v in (p0, lo, hi))
        if how == "auto":
            how = "bounds" if np.isfinite(lo).all() and np.isfinite(hi).all() else "p0"
        self.shift = lo if how == "bounds" else np.zeros_like(p0)
        self.scale = hi - lo if how == "bounds" else np.where(p0 != 0, np.abs(p0), 1.0) if how == "p0" else np.ones_like(p0)

    def forward(self, x):
        return (np.asarray(x, float) - self.shift) / self.scale

    def inverse(self, u):
        return np.asarray(u, float) * self.scale + self.shift

    def covariance(self, c):
        """Covariance in original units from one in normalised units."""
        return np.outer(self.scale, self.scale) * c


def analyse(df: DataFrame, x: str, y: str, k: int = 3) -> dict:
    """n, ratio to parameters, share of outliers, signal to noise, spacing, its uniformity and size class.

    Noise and spacing are of neighbours by x; all pairs count, whatever the number of partitions.
    """
    p = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    n, span = p.agg(F.count("*"), F.max("y") - F.min("y")).first()
    if not n:
        return {"n": 0}
    q1, q3 = frame.quantiles(p, F.col("y"), [0.25, 0.75])
    iqr = q3 - q1
    near = neighbours(p, "x", "y")
    outliers = p.agg(F.avg(F.when((F.col("y") < q1 - 3 * iqr) | (F.col("y") > q3 + 3 * iqr), 1.0).otherwise(0.0))).first()[0]
    sd, mean = near.agg(F.stddev_pop("dx"), F.avg("dx")).first()
    (noise,) = frame.quantiles(near, F.abs("dy"), [0.5])
    return {
        "n": n,
        "ratio": n / k,
        "outlier_share": outliers,
        "snr": span / noise if noise else math.inf,
        "spacing": mean,
        "spacing_spread": sd / mean if mean else None,
        "uniform": bool(mean) and sd / mean < 0.01,
        "size": "small" if n <= 100 else "medium" if n < 10_000 else "large" if n < 1_000_000 else "very_large",
    }


def neighbours(df: DataFrame, x: str, y: str) -> DataFrame:
    """dx and dy of each row to the row before it by (x, y), over range partitions and blocks of ranks; equal rows are split
    like others."""
    p = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    near = frame.lagged(p, [F.col("x"), F.col("y")], ["x", "y"], 1)
    return near.filter("_t = 1").select((F.col("x") - F.col("x_1")).alias("dx"), (F.col("y") - F.col("y_1")).alias("dy"))


def tolerance(n: int, quality: str = "balanced") -> float:
    """1e-12 below a thousand points, a decade looser for each decade more, 1e-5 from 1e8; quality one tier tighter, fast one looser."""
    tier = int(np.clip(math.floor(math.log10(max(n, 1))) - 2, 0, 6))
    tier += {"quality": -1, "balanced": 0, "fast": 1}[quality]
    return 10.0 ** (-12 + int(np.clip(tier, 0, 7)))


def choose(a: dict, quality: str = "balanced") -> dict:
    """Loss by share of outliers, tolerances by size."""
    share = a.get("outlier_share") or 0.0
    loss = "cauchy" if share > 0.1 else "huber" if share > 0.05 else "soft_l1" if share > 0.01 else "linear"
    t = tolerance(a["n"], quality)
    return {"loss": loss, "ftol": t, "xtol": t, "gtol": t}


def pattern(df: DataFrame, x: str, y: str) -> str:
    """linear, gaussian, sigmoid, sigmoid_inv, growth, decay, monotonic or unknown."""
    found = patterns(df.withColumn("_one", F.lit(1)), ["_one"], x, y).first()
    return found.pattern if found else "unknown"


def patterns(df: DataFrame, keys: list, x: str, y: str) -> DataFrame:
    """keys, pattern: of every series of `keys`, from one grouped aggregate and one over the middle fifth of each series."""
    by = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    s = df.groupBy(*by).agg(
        F.corr(x, y).alias("_r"), F.min_by(y, x).alias("_first"), F.max_by(y, x).alias("_last"), F.min(y).alias("_lo"), F.max(y).alias("_hi"),
        F.max_by(x, y).alias("_top"), F.min(x).alias("_x0"), F.max(x).alias("_x1"),
    )
    s = written(s, "patterns")
    few = (lambda t: F.broadcast(t)) if s.count() <= FEW else (lambda t: t)
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.join(few(s.select(*names, "_x0", "_x1")), [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    near = F.abs(F.col(x) - (F.col("_x0") + F.col("_x1")) / 2) < 0.1 * (F.col("_x1") - F.col("_x0"))
    mid = rows.filter(near).groupBy(*names).agg(F.avg(y).alias("_mid"))
    for i in range(len(keys)):
        mid = mid.withColumnRenamed(f"_k{i}", f"_m{i}")
    t = s.join(mid, [F.col(f"_k{i}").eqNullSafe(F.col(f"_m{i}")) for i in range(len(keys))], "left")
    high = F.col("_hi") - F.col("_lo")
    a, b, at = (F.col("_first") - F.col("_lo")) / high, (F.col("_last") - F.col("_lo")) / high, (F.col("_top") - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    middle = F.coalesce(((F.col("_mid") - F.col("_lo")) / high > 0.3) & ((F.col("_mid") - F.col("_lo")) / high < 0.7), F.lit(False))
    kind = (
        F.when(F.col("_r").isNull() | F.isnan("_r") | (high == 0) | (F.col("_x1") == F.col("_x0")), "unknown")
        .when(F.abs("_r") > 0.99, "linear")
        .when((at > 0.2) & (at < 0.8) & (a < 0.5) & (b < 0.5), "gaussian")
        .when((a < 0.2) & (b > 0.8), F.when(middle, "sigmoid").otherwise("growth"))
        .when((a > 0.8) & (b < 0.2), F.when(middle, "sigmoid_inv").otherwise("decay"))
        .when(F.abs("_r") > 0.95, "monotonic")
        .otherwise("unknown")
    )
    return t.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), kind.alias("pattern"))
