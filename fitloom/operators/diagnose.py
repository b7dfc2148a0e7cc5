"""Health of a fit from k x k matrices, and of its history by windows over iterations."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ADVICE = {
    "IDENT-001": "Some directions of the parameters don't change the fit: fix or combine parameters, or add data.",
    "IDENT-002": "The parameters are barely determined: rescale them or start from a simpler model.",
    "CORR-001": "Two parameters trade off against each other: reparametrise or fix one.",
    "SENS-001": "Stiffness spans many orders of magnitude: only combinations of parameters are determined.",
    "SENS-002": "Few directions carry nearly all sensitivity: the model has more parameters than the data support.",
    "GRAD-001": "The gradient vanished while the cost is still high: try other starting values.",
    "GRAD-002": "Gradients of different parameters differ by many orders: rescale the parameters.",
    "GRAD-003": "The gradient stopped changing: loosen tolerances or perturb the start.",
}


@dataclass
class Issue:
    code: str
    severity: str
    category: str
    message: str
    affected: list = field(default_factory=list)
    recommendation: str = ""

    def __post_init__(self):
        self.recommendation = self.recommendation or ADVICE.get(self.code, "")


def fim_correlation(a: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.maximum(np.diag(a), 0))
    d = np.where(d > 0, d, 1.0)
    return a / np.outer(d, d)


def identifiability(a: np.ndarray, cond_limit: float = 1e12, corr_limit: float = 0.95) -> dict:
    """cond, rank, correlated pairs and issues of J'J."""
    lam = np.maximum(np.linalg.eigvalsh(a), 0)
    k, top = len(a), max(lam[-1], 0.0)
    rank = int((lam > top * k * np.finfo(float).eps).sum())
    cond = float(top / lam[0]) if lam[0] > 0 else math.inf
    r = fim_correlation(a)
    pairs = [(i, j, float(r[i, j])) for i in range(k) for j in range(i + 1, k) if abs(r[i, j]) >= corr_limit]
    issues = []
    if rank < k:
        issues.append(Issue("IDENT-001", "critical", "identifiability", f"rank {rank} of {k}"))
    elif cond > cond_limit:
        issues.append(Issue("IDENT-002", "warning", "identifiability", f"condition number {cond:.3g}"))
    issues += [Issue("CORR-001", "warning", "correlation", f"correlation {c:.4f}", [i, j]) for i, j, c in pairs]
    return {"cond": cond, "rank": rank, "pairs": pairs, "issues": issues}


def sensitivity(a: np.ndarray, orders_limit: float = 6.0) -> dict:
    """Spectrum of J'J, its range in decades, participation ratio, stiff and sloppy directions."""
    lam, q = np.linalg.eigh(a)
    lam = np.maximum(lam[::-1], 0)
    q = q[:, ::-1]
    top = lam[0]
    decades = float(np.log10(top / lam[-1])) if lam[-1] > 0 else math.inf
    ratio = float(lam.sum() ** 2 / (lam**2).sum()) if top > 0 else 0.0
    stiff = [i for i, v in enumerate(lam) if v >= top * 1e-2]
    sloppy = [i for i, v in enumerate(lam) if v < top * 10**-orders_limit]
    issues = []
    if decades > orders_limit:
        issues.append(Issue("SENS-001", "warning", "sensitivity", f"{decades:.1f} decades", sloppy))
    if len(lam) > 1 and ratio < 0.5 * len(lam):
        issues.append(Issue("SENS-002", "info", "sensitivity", f"effective dimension {ratio:.2f} of {len(lam)}"))
    return {"eigenvalues": lam, "directions": q, "decades": decades, "effective_dimension": ratio, "stiff": stiff, "sloppy": sloppy, "issues": issues}


def windows(history: DataFrame, by: list | None = None, order: str = "iteration", cost: str = "cost") -> DataFrame:
    """Per iteration: change, sign change, variance of the last 5, means of the last and previous 5, running
    best. Histories are short; without `by` one task orders one history."""
    w = W.partitionBy(*(by or [F.lit(1)])).orderBy(order)
    d = history.withColumn("d_cost", F.col(cost) - F.lag(cost).over(w))
    flip = F.signum("d_cost") * F.signum(F.lag("d_cost").over(w)) < 0
    return (
        d.withColumn("flip", F.coalesce(flip, F.lit(False)).cast("int"))
        .withColumn("var5", F.var_pop(cost).over(w.rowsBetween(-4, 0)))
        .withColumn("mean5", F.avg(cost).over(w.rowsBetween(-4, 0)))
        .withColumn("prev5", F.avg(cost).over(w.rowsBetween(-9, -5)))
        .withColumn("best", F.min(cost).over(w.rowsBetween(W.unboundedPreceding, 0)))
    )


def convergence(history: DataFrame, sensitivity: float = 1.0, by: list | None = None, order: str = "iteration", cost: str = "cost") -> DataFrame:
    """Per history: oscillating, stagnant, diverging over its last ten costs, and the rate -slope of ln |cost|."""
    by = by or []
    d = windows(history, by, order, cost)
    last = W.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc(order))
    d = d.withColumn("_r", F.row_number().over(last))
    ten = F.col("_r") <= 10
    n = F.sum(F.when(ten, 1))
    newest = lambda c: F.max(F.when(F.col("_r") == 1, F.col(c)))
    # flips among the differences of the last ten costs: the first two of them have none inside the window
    flips = F.sum(F.when((F.col("_r") <= F.lit(8)), F.col("flip")).otherwise(0))
    return d.groupBy(*by).agg(
        F.count("*").alias("n"),
        (flips / F.greatest(n - 2, F.lit(1)) > 0.7 * sensitivity).alias("oscillating"),
        (newest("var5") / (F.abs(newest("mean5")) + 1e-10) < 1e-10 * sensitivity).alias("stagnant"),
        F.coalesce(newest("mean5") / newest("prev5") > 1.5 / sensitivity, F.lit(False)).alias("diverging"),
        (-F.regr_slope(F.log(F.abs(cost) + 1e-10), order)).alias("rate"),
    )


def gradient_stats(gradients: DataFrame) -> DataFrame:
    """Per parameter (columns iteration, param, g): mean and sample variance of |g|, last ten's spread, running imbalance."""
    g = F.abs("g")
    w = W.partitionBy("param").orderBy(F.desc("iteration"))
    r = gradients.withColumn("_r", F.row_number().over(w))
    late = F.when(F.col("_r") <= 10, g)
    return r.groupBy("param").agg(F.count("*").alias("n"), F.avg(g).alias("mean"), F.var_samp(g).alias("var"), (F.stddev_pop(late) / F.avg(late)).alias("spread10"))


def gradient_health(norms: list, costs: list, gradients: np.ndarray | None = None) -> dict:
    """Vanishing, imbalance and stagnation of a gradient history; score 1 less 0.3, 0.3 and 0.2."""
    issues, score = [], 1.0
    n, c = np.asarray(norms, float), np.asarray(costs, float)
    if len(n) >= 5:
        if n[-10:].mean() < 1e-6 * max(n[0], 1e-300) and c[-10:].mean() > 1e-10:
            issues.append(Issue("GRAD-001", "warning", "gradient", "vanishing gradient"))
            score -= 0.3
        if n[-10:].mean() > 0 and n[-10:].std() / n[-10:].mean() < 0.01:
            issues.append(Issue("GRAD-003", "info", "gradient", "stagnant gradient"))
            score -= 0.2
    if gradients is not None and np.size(gradients):
        g = np.abs(np.atleast_2d(gradients))
        ratio = max((r[r > 0].max() / r[r > 0].min() for r in g if (r > 0).any()), default=1.0)
        if ratio > 1e6:
            issues.append(Issue("GRAD-002", "warning", "gradient", f"gradients differ by {ratio:.2g}"))
            score -= 0.3
    return {"score": max(score, 0.0), "issues": issues}


def early_stops(history: DataFrame, patience: int, min_delta: float = 0.0, by: list | None = None, order: str = "iteration", cost: str = "cost") -> DataFrame:
    """by, stop: the place in order at which each history would end by callbacks.stopped_at(), null if it would not.

    One pass over each history's array; histories are short."""
    costs = F.transform(F.array_sort(F.collect_list(F.struct(order, cost))), lambda x: F.struct(x[order].cast("long").alias("i"), x[cost].cast("double").alias("c")))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("wait"), F.lit(None).cast("long").alias("stop"))

    def step(acc, x):
        better = acc["best"].isNull() | (x["c"] < acc["best"] - min_delta)
        wait = F.when(better, F.lit(0)).otherwise(acc["wait"] + 1)
        skip = x["c"].isNull() | F.isnan(x["c"]) | (F.abs(x["c"]) == float("inf")) | acc["stop"].isNotNull()
        new = F.struct(F.when(better, x["c"]).otherwise(acc["best"]).alias("best"), wait.alias("wait"), F.when(wait >= patience, x["i"]).alias("stop"))
        return F.when(skip, acc).otherwise(new)

    return history.groupBy(*(by or [])).agg(costs.alias("_h")).select(*(by or []), F.aggregate("_h", start, step, lambda acc: acc["stop"]).alias("stop"))


def gradient_flags(history: DataFrame, by: list | None = None, order: str = "iteration", norm: str = "g_norm", cost: str = "cost") -> DataFrame:
    """Per history of gradient norms and costs: n, vanishing (the last ten norms under 1e-6 of the first at a cost
    that is not 0) and stagnant (their spread under 1 % of their mean)."""
    by = by or []
    keys = by or [F.lit(1)]
    late = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order))) <= 10
    h = history.withColumn("_late", late)
    n, c = F.when(F.col("_late"), F.col(norm)), F.when(F.col("_late"), F.col(cost))
    return h.groupBy(*by).agg(
        F.count("*").alias("n"),
        ((F.avg(n) < 1e-6 * F.min_by(norm, order)) & (F.avg(c) > 1e-10) & (F.count("*") >= 5)).alias("vanishing"),
        ((F.stddev_pop(n) < 0.01 * F.avg(n)) & (F.count("*") >= 5)).alias("stagnant"),
    )


PLUGINS: dict = {}


def register(name: str, check) -> None:
    """check(result) -> list of Issue; a failing plugin is reported, not raised."""
    PLUGINS[name] = check


def health(result) -> dict:
    """All checks of a FitResult: score in 0..1 and issues, worst first."""
    a = result.outcome.state.a
    ident, sens = identifiability(a), sensitivity(a)
    h = result.outcome.history
    grad = gradient_health([x["g_norm"] for x in h], [x["cost"] for x in h])
    issues = [*ident["issues"], *sens["issues"], *grad["issues"]]
    for name, check in PLUGINS.items():
        try:
            issues += check(result)
        except Exception as e:
            issues.append(Issue("PLUGIN", "info", "plugin", f"{name}: {e}"))
    score = 1.0
    score -= 0.4 if ident["rank"] < len(a) else 0.2 if ident["cond"] > 1e12 else 0.0
    score -= 0.05 * min(4, len(ident["pairs"]))
    score = 0.7 * score + 0.3 * grad["score"] - (0.1 if sens["sloppy"] else 0.0)
    rank = {"critical": 0, "warning": 1, "info": 2}
    return {"score": max(0.0, min(1.0, score)), "issues": sorted(issues, key=lambda i: (rank[i.severity], i.code))}


def issues_df(spark, issues: list) -> DataFrame:
    return spark.createDataFrame(
        [tuple(asdict(i).values()) for i in issues], "code string, severity string, category string, message string, affected array<int>, recommendation string"
    )
