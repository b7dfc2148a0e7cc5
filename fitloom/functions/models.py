"""Model library: formulas with parameter names, bounds and rules for starting values.

Rules that depend on row order use the order column; ties go to the first row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import expr as E

INF = math.inf


@dataclass(frozen=True)
class Model:
    """expr over params and variables; start: rule from a prepared frame; bounds by parameter."""

    name: str
    expr: E.Expr
    params: tuple
    variables: tuple = ("x",)
    start: Callable | None = None
    bounds: dict | None = None
    jac: tuple | None = None

    @property
    def gradient(self) -> list:
        return list(self.jac) if self.jac else [E.diff(self.expr, p) for p in self.params]

    @property
    def linear(self) -> bool:
        """Whether no derivative holds a parameter."""
        return not any(E.names(g, "param") for g in self.gradient)

    def limits(self) -> tuple:
        b = self.bounds or {}
        return np.array([b.get(p, (-INF, INF))[0] for p in self.params], float), np.array([b.get(p, (-INF, INF))[1] for p in self.params], float)

    def numpy(self):
        """f(theta, {variable: array})."""
        return self.values

    def values(self, theta, v: dict) -> np.ndarray:
        return E.to_numpy(self.expr)(dict(zip(self.params, theta)), v)

    def jacobian(self, theta, v: dict) -> np.ndarray:
        p, n = dict(zip(self.params, theta)), np.shape(v[self.variables[0]])
        return np.stack([np.broadcast_to(E.to_numpy(g)(p, v), n) for g in self.gradient], 1)

    def column(self, theta, columns: dict):
        return E.to_column(self.expr, dict(zip(self.params, theta)), columns)

    def slopes(self, theta, columns: dict) -> list:
        return [E.to_column(g, dict(zip(self.params, theta)), columns) for g in self.gradient]


def formula(text: str, params: tuple | None = None, variables: tuple = ("x",), name: str = "formula", jac: tuple | None = None, **more) -> Model:
    """A model from text; parameters in the order of their first use unless given. jac: its derivatives as
    text, in the parameters' order, in place of the symbolic ones."""
    e = E.parse(text, variables)
    given = tuple(E.parse(g, variables) for g in jac) if jac else None
    return Model(name, e, tuple(params or E.names(e, "param")), tuple(variables), jac=given, **more)


# ---- starting values: each rule takes a frame of x, y, ord (finite rows) ----


def summary(df: DataFrame) -> dict:
    r = df.agg(
        F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.avg("x").alias("xm"),
        F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("y").alias("ym"),
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("cut"),
        F.min_by("x", F.struct(-F.col("y"), "ord")).alias("x_top"),
    ).first()
    return r.asDict()


def nearest(df: DataFrame, y: float) -> float:
    """x of the row whose y is nearest."""
    return df.agg(F.min_by("x", F.struct(F.abs(F.col("y") - y), "ord"))).first()[0]


def half_width(df: DataFrame, s: dict) -> float | None:
    """Distance in x between the first and the last row above half height."""
    half = s["y0"] + (s["y1"] - s["y0"]) / 2
    r = df.filter(F.col("y") > half).agg(F.min_by("x", "ord").alias("a"), F.max_by("x", "ord").alias("b")).first()
    return None if r.a is None or r.a == r.b else abs(r.b - r.a)


def start_linear(df):
    s = summary(df)
    return [1.0, s["ym"]] if s["slope"] is None else [s["slope"], s["cut"]]


def start_decay(df):
    s = summary(df)
    half = nearest(df, (s["y1"] + s["y0"]) / 2)
    span = s["x1"] - s["x0"]
    b = math.log(2) / half if half > 0 else 1 / span if span > 0 else 0.1
    return [s["y1"] - s["y0"], max(b, 0.01), s["y0"]]


def start_growth(df):
    s = summary(df)
    span = s["x1"] - s["x0"]
    return [s["y0"], math.log(s["y1"] / s["y0"]) / span if s["y0"] > 0 and span > 0 else 0.1, 0.0]


def start_peak(divide: float):
    def rule(df):
        s = summary(df)
        width = half_width(df, s)
        scale = width / divide if width else (s["x1"] - s["x0"]) / 4
        return [s["y1"] - s["y0"], s["x_top"], max(scale, 0.01)]

    return rule


def start_sigmoid(df):
    s = summary(df)
    span = s["x1"] - s["x0"]
    return [s["y1"] - s["y0"], nearest(df, (s["y1"] + s["y0"]) / 2), 1 / span if span > 0 else 1.0, s["y0"]]


def start_power(df):
    r = df.filter("x > 0 and y > 0").agg(F.regr_slope(F.log("y"), F.log("x")).alias("b"), F.regr_intercept(F.log("y"), F.log("x")).alias("a")).first()
    return [1.0, 1.0] if r.a is None or r.b is None else [math.exp(r.a), r.b]


def start_polynomial(degree: int):
    def rule(df):
        x, y = F.col("x"), F.col("y")
        powers = [F.sum(x**i).alias(f"s{i}") for i in range(2 * degree + 1)] + [F.sum(y * x**i).alias(f"t{i}") for i in range(degree + 1)]
        r = df.agg(*powers, F.avg("y").alias("ym")).first()
        a = np.array([[r[f"s{2 * degree - i - j}"] for j in range(degree + 1)] for i in range(degree + 1)], float)
        b = np.array([r[f"t{degree - i}"] for i in range(degree + 1)], float)
        d = np.sqrt(np.maximum(np.diag(a), 1e-300))
        if np.linalg.matrix_rank(a / np.outer(d, d)) <= degree:
            return [0.0] * degree + [r.ym]
        return list(np.linalg.solve(a / np.outer(d, d), b / d) / d)

    return rule


def turns(df: DataFrame, centre: float = 0.0) -> DataFrame:
    """x, y - centre, whether the row is a peak of |y - centre|, and where y crosses the centre before the next row
    (null where it doesn't). A curve's rows are ordered by one window: it is for starting rules on short series."""
    w = W.orderBy("x", "ord")
    c = df.select("x", "ord", (F.col("y") - centre).alias("y"))
    a = F.abs("y")
    peak = (a > F.lag(a).over(w)) & (a > F.lead(a).over(w))
    nx, ny = F.lead("x").over(w), F.lead("y").over(w)
    cross = F.when(F.col("y") * ny < 0, F.col("x") - F.col("y") * (nx - F.col("x")) / (ny - F.col("y")))
    return c.select("x", "y", F.coalesce(peak, F.lit(False)).alias("peak"), cross.alias("crossing"))


def start_oscillation(df, bins: int = 2000):
    """Amplitude from the largest |y|, decay from the peaks' logarithms, frequency from the mean distance of zero
    crossings, phase from the first value; around the mean of y. Longer series are averaged in `bins` first."""
    s = summary(df)
    span = s["x1"] - s["x0"]
    if s["n"] > bins and span > 0:
        i = F.least(F.floor((F.col("x") - s["x0"]) / (span / bins)), F.lit(bins - 1))
        df = df.groupBy(i.alias("ord")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    t = turns(df, s["ym"]).agg(
        F.max(F.abs("y")).alias("top"), F.count(F.when(F.col("peak") & (F.col("y") != 0), 1)).alias("peaks"),
        F.regr_slope(F.when(F.col("peak") & (F.col("y") != 0), F.log(F.abs("y"))), F.col("x")).alias("slope"),
        F.count("crossing").alias("n"), F.min("crossing").alias("c0"), F.max("crossing").alias("c1"), F.min_by("y", "x").alias("first"),
    ).first()
    size = t.top or 1.0
    decay = max(-t.slope, 0.01) if t.peaks >= 2 and t.slope is not None else 1 / span if span > 0 else 0.1
    gap = (t.c1 - t.c0) / (t.n - 1) if t.n >= 2 else 0.0
    omega = math.pi / gap if gap > 0 else 2 * math.pi / span if span > 0 else 1.0
    return [size, decay, omega, math.acos(max(-1.0, min(1.0, t.first / size))) - omega * s["x0"], s["ym"]]


def _m(name, text, params, **more) -> Model:
    return formula(text, tuple(params.split()), name=name, **more)


def polynomial(degree: int) -> Model:
    """Highest power first, by Horner's rule."""
    text = "c0"
    for i in range(1, degree + 1):
        text = f"({text})*x + c{i}"
    return formula(text, tuple(f"c{i}" for i in range(degree + 1)), name=f"polynomial_{degree}", start=start_polynomial(degree))


POSITIVE = (0.0, INF)
FWHM = 2 * math.sqrt(2 * math.log(2))
MODELS = {
    m.name: m
    for m in (
        _m("linear", "a*x + b", "a b", start=start_linear),
        _m("exponential_decay", "a*exp(-b*x) + c", "a b c", start=start_decay, bounds={"b": POSITIVE}),
        _m("exponential_growth", "a*exp(b*x) + c", "a b c", start=start_growth, bounds={"a": POSITIVE, "b": POSITIVE}),
        _m("gaussian", "amp*exp(-(x - mu)^2/(2*sigma^2))", "amp mu sigma", start=start_peak(FWHM), bounds={"amp": POSITIVE, "sigma": POSITIVE}),
        _m("lorentzian", "amp/(1 + ((x - x0)/gamma)^2)", "amp x0 gamma", start=start_peak(2.0), bounds={"amp": POSITIVE, "gamma": POSITIVE}),
        _m("sigmoid", "L/(1 + exp(-k*(x - x0))) + b", "L x0 k b", start=start_sigmoid, bounds={"L": POSITIVE, "k": POSITIVE}),
        _m("power_law", "a*x^b", "a b", start=start_power, bounds={"a": POSITIVE}),
        polynomial(2),
        polynomial(3),
        _m("damped_oscillator", "A*exp(-g*x)*cos(w*x + phi) + c", "A g w phi c", start=start_oscillation),
        _m("gaussian_peak", "amp*exp(-(x - mu)^2/(2*sigma^2)) + base", "amp mu sigma base"),
        _m("lorentzian_peak", "amp*gamma^2/((x - x0)^2 + gamma^2) + base", "amp x0 gamma base"),
        _m("pseudo_voigt", "amp*(eta/(1 + ((x - x0)/(w/2))^2) + (1 - eta)*exp(-4*log(2)*((x - x0)/w)^2)) + base", "amp x0 w eta base", bounds={"eta": (0.0, 1.0)}),
        _m("double_gaussian", "a1*exp(-(x - m1)^2/(2*s1^2)) + a2*exp(-(x - m2)^2/(2*s2^2))", "a1 m1 s1 a2 m2 s2"),
        _m("double_exponential", "a1*exp(-b1*x) + a2*exp(-b2*x) + c", "a1 b1 a2 b2 c"),
        _m("stretched_exponential", "a*exp(-(max(x, 0)/tau)^beta) + c", "a tau beta c", bounds={"tau": POSITIVE, "beta": (0.0, 2.0)}),
        _m("hill", "vmax*x^n/(k^n + x^n)", "vmax k n", bounds={"k": POSITIVE, "n": POSITIVE}),
        _m("michaelis_menten", "vmax*x/(km + x)", "vmax km", bounds={"km": POSITIVE}),
        _m("four_parameter_logistic", "d + (a - d)/(1 + (x/c)^b)", "a b c d", bounds={"c": POSITIVE}),
        _m("power_law_offset", "a*x^b + c", "a b c"),
        _m("planck", "a*x^3/(exp(min(max(x/t, 0), 700)) - 1)", "a t", bounds={"t": POSITIVE}),
        _m("piecewise_linear", "where(x < x0, y0 + k1*(x - x0), y0 + k2*(x - x0))", "x0 y0 k1 k2"),
        _m("safe_exponential_decay", "a*exp(min(max(-b*x, -500), 500)) + c", "a b c"),
        _m("quadratic", "a*x^2 + b*x + c", "a b c"),
        _m("sinusoid", "a*sin(b*x + c)", "a b c"),
        formula("amp*exp(-((x - x0)^2/(2*sx^2) + (y - y0)^2/(2*sy^2))) + base", ("amp", "x0", "y0", "sx", "sy", "base"), ("x", "y"), "gaussian_2d"),
        formula(
            "amp*exp(-(((x - x0)*cos(t) + (y - y0)*sin(t))^2/(2*sx^2) + ((y - y0)*cos(t) - (x - x0)*sin(t))^2/(2*sy^2))) + base",
            ("amp", "x0", "y0", "sx", "sy", "t", "base"), ("x", "y"), "gaussian_2d_rotated",
        ),
    )
}


def safe_log(e: E.Expr, floor: float = 1e-10) -> E.Expr:
    """log of e, or of floor where e is less."""
    return E.log(E.make("max", e, E.const(floor)))


def safe_sqrt(e: E.Expr, floor: float = 0.0) -> E.Expr:
    """Square root of e, or of floor where e is less."""
    return E.sqrt(E.make("max", e, E.const(floor)))


def safe_exp(e: E.Expr, most: float = 700.0) -> E.Expr:
    """exp of e kept within +-most, so that it stays finite."""
    return E.exp(E.clip(e, E.const(-most), E.const(most)))


def safe_power(base: E.Expr, exponent: E.Expr, floor: float = 1e-10) -> E.Expr:
    """|base| (floor at least) to the exponent."""
    return E.make("^", E.make("max", E.abs_(base), E.const(floor)), exponent)


def safe_divide(a: E.Expr, b: E.Expr, eps: float = 1e-10) -> E.Expr:
    """a / b with denominators nearer to 0 than eps replaced by eps."""
    return a / E.where(E.abs_(b) < E.const(eps), E.const(eps), b)


def named(model, degree: int | None = None) -> Model:
    """A Model or numeric model as it is; a registered name, "polynomial" with a degree, or a formula."""
    if not isinstance(model, str):
        return model
    if model == "polynomial":
        return polynomial(degree or 1)
    return MODELS[model] if model in MODELS else formula(model)


def with_start(model: Model, rule: Callable, bounds: dict | None = None) -> Model:
    """A user's model with its own starting rule and bounds."""
    return replace(model, start=rule, bounds=bounds or model.bounds)
