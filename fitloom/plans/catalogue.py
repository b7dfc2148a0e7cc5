"""Registered queries over the driver's tables, each with the SQL that gives the same rows.

Numbers are rounded alike on both sides. A series for nonlinear fits is the histogram of events.value
below 300 in bins of 10; the SQL side iterates Gauss-Newton in a recursive query from the same start.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.losses import loss
from ..functions.models import MODELS, formula, named
from ..functions.numeric import Numeric
from ..operators import chunked, correlated, diagnose, frame, normal, precision, search
from ..operators.fit import FitResult, curve_fit
from ..operators.grouped import fit_by_key
from ..operators.hybrid import hybrid_fit
from ..plans import workflows
from ..sources import writers
from ..streaming.incremental import Incremental, windowed_linear

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


def rnd(c, digits: int = 6):
    return F.round(c, digits)


def values(spark, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---- series ----

BINS = "bins AS (SELECT floor(value / 10) * 10 + 5.0 AS x, count(*)::DOUBLE AS y FROM events WHERE value < 300 GROUP BY 1)"


def bins(spark, d) -> DataFrame:
    e = read(spark, d, "events").filter("value < 300")
    return e.groupBy((F.floor(F.col("value") / 10) * 10 + 5.0).cast("double").alias("x")).agg(F.count("*").cast("double").alias("y"))


def price_on_quantity(spark, d, **more) -> FitResult:
    return curve_fit(read(spark, d, "lineitem"), "linear", "l_quantity", "l_extendedprice", **more)


LINE = """line AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b,
 count(*) AS n, sum(l_quantity) AS sx, sum(l_quantity * l_quantity) AS sxx FROM lineitem),
 err AS (SELECT a, b, n, sx, sxx, sum(power(l_extendedprice - a * l_quantity - b, 2)) AS rss, sum(abs(l_extendedprice - a * l_quantity - b)) AS ab,
 var_pop(l_extendedprice) * count(*) AS tss FROM lineitem, line GROUP BY ALL)"""


# ---- linear fits ----


@query("SELECT param, round(value, 4) AS value FROM (SELECT 'a' AS param, regr_slope(l_extendedprice, l_quantity) AS value FROM lineitem UNION ALL SELECT 'b', regr_intercept(l_extendedprice, l_quantity) FROM lineitem)")
def linear_fit(spark, d):
    f = price_on_quantity(spark, d)
    return values(spark, list(f.params.items()), "param string, value double").select("param", rnd("value", 4).alias("value"))


@query("SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS a, round(regr_intercept(l_extendedprice, l_quantity), 4) AS b FROM lineitem GROUP BY 1")
def linear_fit_by_group(spark, d):
    g = fit_by_key(read(spark, d, "lineitem"), "linear", "l_quantity", "l_extendedprice", ["l_returnflag"], [1.0, 1.0])
    return g.select("l_returnflag", "n", rnd(F.col("params")[0], 4).alias("a"), rnd(F.col("params")[1], 4).alias("b"))


@query("SELECT l_linenumber, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS a, round(regr_intercept(l_extendedprice, l_quantity), 4) AS b FROM lineitem GROUP BY 1")
def linear_fit_by_large_group(spark, d):
    g = fit_by_key(read(spark, d, "lineitem"), "linear", "l_quantity", "l_extendedprice", ["l_linenumber"], [1.0, 1.0], group_rows=500)
    return g.select("l_linenumber", "n", rnd(F.col("params")[0], 4).alias("a"), rnd(F.col("params")[1], 4).alias("b"))


@query("""SELECT param, round(value, 4) AS value FROM (
 WITH s AS (SELECT sum(w) AS s0, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * y) AS sy, sum(w * x * y) AS sxy
 FROM (SELECT l_quantity AS x, l_extendedprice AS y, 1 / power(1 + l_tax, 2) AS w FROM lineitem))
 SELECT 'a' AS param, (s0 * sxy - sx * sy) / (s0 * sxx - sx * sx) AS value FROM s
 UNION ALL SELECT 'b', (sxx * sy - sx * sxy) / (s0 * sxx - sx * sx) FROM s)""")
def weighted_linear_fit(spark, d):
    rows = read(spark, d, "lineitem").withColumn("sigma", 1 + F.col("l_tax"))
    f = curve_fit(rows, "linear", "l_quantity", "l_extendedprice", sigma="sigma")
    return values(spark, list(f.params.items()), "param string, value double").select("param", rnd("value", 4).alias("value"))


@query(f"""WITH {LINE}, c AS (SELECT rss / (n - 2) / (n * sxx - sx * sx) AS f, n, sx, sxx FROM err)
 SELECT 0 AS i, 0 AS j, round(f * n, 6) AS c FROM c UNION ALL SELECT 0, 1, round(-f * sx, 6) FROM c UNION ALL SELECT 1, 1, round(f * sxx, 4) FROM c""")
def linear_pcov(spark, d):
    c = price_on_quantity(spark, d).pcov
    rows = [(0, 0, float(c[0, 0]), 6), (0, 1, float(c[0, 1]), 6), (1, 1, float(c[1, 1]), 4)]
    return values(spark, [(i, j, v, k) for i, j, v, k in rows], "i int, j int, c double, k int").select("i", "j", F.when(F.col("k") == 6, rnd("c", 6)).otherwise(rnd("c", 4)).alias("c"))


@query(f"""WITH {LINE} SELECT n, round(1 - rss / tss, 8) AS r2, round(1 - (rss / tss) * (n - 1) / (n - 3), 8) AS adj_r2, round(sqrt(rss / n), 3) AS rmse,
 round(ab / n, 3) AS mae, round(4 + n * ln(rss / n), 2) AS aic, round(2 * ln(n) + n * ln(rss / n), 2) AS bic FROM err""")
def fit_stats(spark, d):
    s = price_on_quantity(spark, d).stats()
    row = values(spark, [tuple(s[k] for k in ("n", "r2", "adj_r2", "rmse", "mae", "aic", "bic"))], "n long, r2 double, adj_r2 double, rmse double, mae double, aic double, bic double")
    return row.select("n", rnd("r2", 8).alias("r2"), rnd("adj_r2", 8).alias("adj_r2"), rnd("rmse", 3).alias("rmse"), rnd("mae", 3).alias("mae"), rnd("aic", 2).alias("aic"), rnd("bic", 2).alias("bic"))


#: Student's t at 0.975 from the normal quantile by its series in 1 / dof; enough for large dof.
T975 = "(1.959963984540054 + 2.372271224 / {v} + 2.822498670 / power({v}, 2) + 2.555849780 / power({v}, 3))"


@query(f"""WITH {LINE}, c AS (SELECT a, b, rss / (n - 2) / (n * sxx - sx * sx) AS f, n, sx, sxx, {T975.format(v="(n - 2)")} AS t FROM err)
 SELECT 'a' AS param, round(a - t * sqrt(f * n), 2) AS lower, round(a + t * sqrt(f * n), 2) AS upper FROM c
 UNION ALL SELECT 'b', round(b - t * sqrt(f * sxx), 1), round(b + t * sqrt(f * sxx), 1) FROM c""")
def confidence_intervals(spark, d):
    i = price_on_quantity(spark, d).intervals()
    side = lambda c: F.when(F.col("param") == "a", rnd(c, 2)).otherwise(rnd(c, 1)).alias(c)
    return i.select("param", side("lower"), side("upper"))


@query(f"WITH {LINE} SELECT l_orderkey, l_linenumber, round(a * l_quantity + b, 3) AS y_hat, round(l_extendedprice - a * l_quantity - b, 3) AS residual FROM lineitem, line")
def predictions(spark, d):
    f = price_on_quantity(spark, d)
    rows = read(spark, d, "lineitem")
    hat = E.to_column(f.model.expr, f.params, {"x": "l_quantity"})
    return rows.select("l_orderkey", "l_linenumber", rnd(hat, 3).alias("y_hat"), rnd(F.col("l_extendedprice") - hat, 3).alias("residual"))


PART = """p AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part), l AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM p),
 e AS (SELECT a, b, n, sx, sxx, sum(power(y - a * x - b, 2)) / (n - 2) AS s2 FROM p, l GROUP BY a, b, n, sx, sxx)"""


@query(f"""WITH {PART}, c AS (SELECT *, s2 / (n * sxx - sx * sx) AS f, {T975.format(v="(n - 2)")} AS t FROM e)
 SELECT DISTINCT x, round(a * x + b - t * sqrt(f * (n * x * x - 2 * sx * x + sxx)), 3) AS lower, round(a * x + b + t * sqrt(f * (n * x * x - 2 * sx * x + sxx)), 3) AS upper FROM p, c""")
def confidence_band(spark, d):
    f = curve_fit(read(spark, d, "part"), "linear", "p_size", "p_retailprice")
    return f.predict().select(F.col("v_x").alias("x"), rnd("lower", 3).alias("lower"), rnd("upper", 3).alias("upper")).distinct()


@query(f"""WITH {PART}, c AS (SELECT *, s2 / (n * sxx - sx * sx) AS f, {T975.format(v="(n - 2)")} AS t FROM e)
 SELECT DISTINCT x, round(a * x + b - t * sqrt(s2 * (1 + f * (n + sxx) / 2)), 2) AS lower, round(a * x + b + t * sqrt(s2 * (1 + f * (n + sxx) / 2)), 2) AS upper FROM p, c""")
def prediction_interval(spark, d):
    f = curve_fit(read(spark, d, "part"), "linear", "p_size", "p_retailprice")
    return f.predict().select(F.col("v_x").alias("x"), rnd("pred_lower", 2).alias("lower"), rnd("pred_upper", 2).alias("upper")).distinct()


POLY = """s AS (SELECT count(*)::DOUBLE AS s0, sum(x) AS s1, sum(x * x) AS s2, sum(x * x * x) AS s3, sum(x * x * x * x) AS s4, sum(y) AS t0, sum(x * y) AS t1, sum(x * x * y) AS t2 FROM p),
 k AS (SELECT *, s4 * (s2 * s0 - s1 * s1) - s3 * (s3 * s0 - s1 * s2) + s2 * (s3 * s1 - s2 * s2) AS det FROM s)"""


@query(f"""WITH p AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part), {POLY}
 SELECT round((t2 * (s2 * s0 - s1 * s1) - s3 * (t1 * s0 - s1 * t0) + s2 * (t1 * s1 - s2 * t0)) / det, 5) AS c0,
 round((s4 * (t1 * s0 - s1 * t0) - t2 * (s3 * s0 - s1 * s2) + s2 * (s3 * t0 - t1 * s2)) / det, 4) AS c1,
 round((s4 * (s2 * t0 - t1 * s1) - s3 * (s3 * t0 - t1 * s2) + t2 * (s3 * s1 - s2 * s2)) / det, 3) AS c2 FROM k""")
def polynomial_fit_2(spark, d):
    c = curve_fit(read(spark, d, "part"), "polynomial_2", "p_size", "p_retailprice").popt.tolist()
    return values(spark, [tuple(c)], "c0 double, c1 double, c2 double").select(rnd("c0", 5).alias("c0"), rnd("c1", 4).alias("c1"), rnd("c2", 3).alias("c2"))


@query("""WITH s AS (SELECT count(*)::DOUBLE AS n, sum(u) AS u, sum(v) AS v, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, sum(y) AS y, sum(u * y) AS uy, sum(v * y) AS vy
 FROM (SELECT l_quantity AS u, l_discount AS v, l_extendedprice AS y FROM lineitem)), k AS (SELECT *, uu * (vv * n - v * v) - uv * (uv * n - v * u) + u * (uv * v - vv * u) AS det FROM s)
 SELECT round((uy * (vv * n - v * v) - uv * (vy * n - v * y) + u * (vy * v - vv * y)) / det, 3) AS b1, round((uu * (vy * n - v * y) - uy * (uv * n - v * u) + u * (uv * y - vy * u)) / det, 2) AS b2,
 round((uu * (vv * y - vy * v) - uv * (uv * y - vy * u) + uy * (uv * v - vv * u)) / det, 2) AS b0 FROM k""")
def multi_feature_linear(spark, d):
    m = formula("b1*u + b2*v + b0", ("b1", "b2", "b0"), ("u", "v"))
    c = curve_fit(read(spark, d, "lineitem"), m, ["l_quantity", "l_discount"], "l_extendedprice").popt.tolist()
    return values(spark, [tuple(c)], "b1 double, b2 double, b0 double").select(rnd("b1", 3).alias("b1"), rnd("b2", 2).alias("b2"), rnd("b0", 2).alias("b0"))


# ---- nonlinear fits: Gauss-Newton in SQL ----


def gauss_newton(series: str, f: str, da: str, db: str, start: str, steps: int, digits: int, ra: str = "a", rb: str = "b") -> str:
    """Two-parameter Gauss-Newton by Cramer's rule over the CTE d(x, y)."""
    return f"""WITH RECURSIVE {series}, it(i, a, b) AS (SELECT 0, a0::DOUBLE, b0::DOUBLE FROM ({start}) UNION ALL
 SELECT i + 1, a - (g1 * h22 - g2 * h12) / (h11 * h22 - h12 * h12), b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (
 SELECT i, a, b, sum(({da}) * ({da})) AS h11, sum(({da}) * ({db})) AS h12, sum(({db}) * ({db})) AS h22, sum(({da}) * (({f}) - y)) AS g1, sum(({db}) * (({f}) - y)) AS g2
 FROM it, d WHERE i < {steps} GROUP BY i, a, b))
 SELECT round(a, {digits}) AS {ra}, round(b, 8) AS {rb} FROM it WHERE i = {steps}"""


DECAY = formula("a*exp(-b*x)", ("a", "b"))


@query(gauss_newton(f"{BINS}, d AS (SELECT * FROM bins)", "a * exp(-b * x)", "exp(-b * x)", "-a * x * exp(-b * x)", "SELECT max(y) AS a0, 0.02 AS b0 FROM d", 25, 4))
def exp_decay_fit(spark, d):
    s = bins(spark, d)
    f = curve_fit(s, DECAY, "x", "y", p0=[s.agg(F.max("y")).first()[0], 0.02], ftol=1e-15, xtol=1e-14, gtol=1e-9)
    return values(spark, [tuple(f.popt.tolist())], "a double, b double").select(rnd("a", 4).alias("a"), rnd("b", 8).alias("b"))


@query(gauss_newton("d AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem)", "a * power(x, b)", "power(x, b)", "a * power(x, b) * ln(x)", "SELECT avg(y) AS a0, 0.0 AS b0 FROM d", 12, 1).replace("round(b, 8)", "round(b, 6)"))
def power_law_fit(spark, d):
    rows = read(spark, d, "lineitem")
    m = formula("a*x^b", ("a", "b"))
    f = curve_fit(rows, m, "l_quantity", "l_extendedprice", p0=[rows.agg(F.avg("l_extendedprice")).first()[0], 0.0], ftol=1e-15, xtol=1e-12, gtol=1e-6)
    return values(spark, [tuple(f.popt.tolist())], "a double, b double").select(rnd("a", 1).alias("a"), rnd("b", 6).alias("b"))


@query(gauss_newton(f"{BINS}, d AS (SELECT * FROM bins WHERE x < 100)", "a / (1 + b * x)", "1 / (1 + b * x)", "-a * x / power(1 + b * x, 2)", "SELECT max(y) AS a0, 0.02 AS b0 FROM d", 40, 3).replace("round(b, 8)", "round(b, 7)"))
def hyperbolic_decay_fit(spark, d):
    s = bins(spark, d).filter("x < 100")
    m = formula("a/(1 + b*x)", ("a", "b"))
    f = curve_fit(s, m, "x", "y", p0=[s.agg(F.max("y")).first()[0], 0.02], ftol=1e-15, xtol=1e-14, gtol=1e-9)
    return values(spark, [tuple(f.popt.tolist())], "a double, b double").select(rnd("a", 3).alias("a"), rnd("b", 7).alias("b"))


@query("""WITH RECURSIVE it(i, a) AS (SELECT 0, 30.0::DOUBLE UNION ALL SELECT i + 1, a + sw / w FROM (
 SELECT i, a, sum(CASE WHEN abs(value - a) < 10 THEN value - a ELSE 10 * sign(value - a) END) AS sw, sum(CASE WHEN abs(value - a) < 10 THEN 1.0 ELSE 10 / abs(value - a) END) AS w
 FROM it, events WHERE i < 80 GROUP BY i, a)) SELECT round(a, 4) AS a FROM it WHERE i = 80""")
def huber_location_fit(spark, d):
    f = curve_fit(read(spark, d, "events"), formula("a + 0*x", ("a",)), "value", "value", p0=[30.0], loss="huber", f_scale=10.0, ftol=1e-15, xtol=1e-12, gtol=1e-7)
    return values(spark, [(float(f.popt[0]),)], "a double").select(rnd("a", 4).alias("a"))


def _bounded_sql() -> str:
    return f"WITH {BINS}, t AS (SELECT exp(-0.03 * x) AS e, y FROM bins) SELECT round(sum(e * y) / sum(e * e), 1) AS a, 0.03 AS b FROM t"


@query(_bounded_sql())
def bounded_fit(spark, d):
    """The free optimum lies near b = 0.02, so the bound b >= 0.03 is active and a has a closed form."""
    f = curve_fit(bins(spark, d), DECAY, "x", "y", p0=[1000.0, 0.05], bounds=([0.0, 0.03], [1e9, 1.0]), ftol=1e-15, xtol=1e-13, gtol=1e-9)
    e = values(spark, [tuple(f.popt.tolist())], "a double, b double")
    return e.select(rnd("a", 1).alias("a"), rnd("b", 6).alias("b"))


# ---- starting values ----

SPAN = "s AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, arg_min(x, struct_pack(k := -y, o := x)) AS top FROM bins)"
NEAR = "n AS (SELECT arg_min(x, struct_pack(k := abs(y - (y0 + y1) / 2), o := x)) AS xh FROM bins, s)"
HALF = "h AS (SELECT min(x) AS h0, max(x) AS h1 FROM bins, s WHERE y > y0 + (y1 - y0) / 2)"
P0_SQL = {
    "exponential_decay": f"WITH {BINS}, {SPAN}, {NEAR} SELECT round(y1 - y0, 6) AS a, round(greatest(CASE WHEN xh > 0 THEN ln(2) / xh ELSE 1 / (x1 - x0) END, 0.01), 6) AS b, round(y0, 6) AS c FROM s, n",
    "exponential_growth": f"WITH {BINS}, {SPAN} SELECT round(y0, 6) AS a, round(CASE WHEN y0 > 0 THEN ln(y1 / y0) / (x1 - x0) ELSE 0.1 END, 6) AS b, 0.0 AS c FROM s",
    "gaussian": f"WITH {BINS}, {SPAN}, {HALF} SELECT round(y1 - y0, 6) AS amp, top AS mu, round(greatest(CASE WHEN h1 > h0 THEN (h1 - h0) / (2 * sqrt(2 * ln(2))) ELSE (x1 - x0) / 4 END, 0.01), 6) AS sigma FROM s, h",
    "lorentzian": f"WITH {BINS}, {SPAN}, {HALF} SELECT round(y1 - y0, 6) AS amp, top AS x0, round(greatest(CASE WHEN h1 > h0 THEN (h1 - h0) / 2 ELSE (x1 - x0) / 4 END, 0.01), 6) AS gamma FROM s, h",
    "sigmoid": f'WITH {BINS}, {SPAN}, {NEAR} SELECT round(y1 - y0, 6) AS "L", xh AS x0, round(1 / (x1 - x0), 6) AS k, round(y0, 6) AS b FROM s, n',
    "power_law": f"WITH {BINS} SELECT round(exp(regr_intercept(ln(y), ln(x))), 4) AS a, round(regr_slope(ln(y), ln(x)), 6) AS b FROM bins WHERE x > 0 AND y > 0",
    "linear": f"WITH {BINS} SELECT round(regr_slope(y, x), 6) AS a, round(regr_intercept(y, x), 4) AS b FROM bins",
}


def _p0(name: str):
    def run(spark, d):
        m = MODELS[name]
        s = bins(spark, d).withColumn("ord", F.col("x"))
        row = values(spark, [tuple(map(float, m.start(s)))], ", ".join(f"`{p}` double" for p in m.params))
        four = {("power_law", "a"), ("linear", "b")}
        return row.select(*(rnd(p, 4 if (name, p) in four else 6).alias(p) for p in m.params))

    return run


for _name, _sql in P0_SQL.items():
    query(_sql, f"{_name}_p0")(_p0(_name))


# ---- costs, normal matrices ----

RHO_SQL = {
    "linear": "z",
    "soft_l1": "2 * (sqrt(1 + z) - 1)",
    "huber": "CASE WHEN z <= 1 THEN z ELSE 2 * sqrt(z) - 1 END",
    "cauchy": "ln(1 + z)",
    "arctan": "atan(z)",
}


def _cost(which: str):
    def run(spark, d):
        z = ((F.col("value") - 50) / 10) ** 2
        return read(spark, d, "events").agg(rnd(F.sum(50.0 * E.to_column(loss(which)[0], {}, {"z": z})), 3).alias("cost"))

    return run


for _name, _sql in RHO_SQL.items():
    query(f"SELECT round(sum(50.0 * ({_sql})), 3) AS cost FROM (SELECT power((value - 50) / 10, 2) AS z FROM events)", f"robust_cost_{_name}")(_cost(_name))

CUBE = "SELECT l_discount AS x, l_tax AS y FROM lineitem"


def _state(spark, d):
    pts = frame.points(read(spark, d, "lineitem"), frame.Roles.of("l_discount", "l_tax"))
    t = normal.terms(MODELS["exponential_decay"], [1.0, 2.0, 0.5])
    return normal.unpacked(pts.agg(*normal.aggregates(t)).first(), [1.0, 2.0, 0.5])


JS = f"j AS (SELECT exp(-2 * x) AS j0, -x * exp(-2 * x) AS j1, 1.0 AS j2, exp(-2 * x) + 0.5 - y AS r FROM ({CUBE}))"


@query(f"WITH {JS} SELECT i, j, round(a, 6) AS a FROM (" + " UNION ALL ".join(f"SELECT {i} AS i, {k} AS j, sum(j{i} * j{k}) AS a FROM j" for i in range(3) for k in range(i, 3)) + ")")
def normal_matrix(spark, d):
    a = _state(spark, d).a
    return values(spark, [(i, j, float(a[i, j])) for i in range(3) for j in range(i, 3)], "i int, j int, a double").select("i", "j", rnd("a").alias("a"))


@query(f"WITH {JS} SELECT i, round(g, 6) AS g FROM (" + " UNION ALL ".join(f"SELECT {i} AS i, sum(j{i} * r) AS g FROM j" for i in range(3)) + ")")
def gradient_vector(spark, d):
    g = _state(spark, d).g
    return values(spark, [(i, float(x)) for i, x in enumerate(g)], "i int, g double").select("i", rnd("g").alias("g"))


GRID = [(100.0 * (i + 1), 0.005 * (j + 1)) for i in range(8) for j in range(8)]
GRID_SQL = "g AS (SELECT i * 8 + j AS start_id, 100.0 * (i + 1) AS a, 0.005 * (j + 1) AS b FROM range(8) r(i), range(8) q(j))"


@query(f"WITH {BINS}, {GRID_SQL} SELECT start_id::INTEGER AS start_id, round(sum(power(a * exp(-b * x) - y, 2)) / 2, 3) AS cost FROM g, bins GROUP BY 1")
def cost_scan(spark, d):
    s = frame.points(bins(spark, d), frame.Roles.of("x", "y"))
    c = search.population_costs(s, DECAY, np.array(GRID))[:, 0]
    return values(spark, [(i, float(x)) for i, x in enumerate(c)], "start_id int, cost double").select("start_id", rnd("cost", 3).alias("cost"))


@query(f"""WITH {BINS}, {GRID_SQL}, c AS (SELECT start_id::INTEGER AS start_id, sum(power(a * exp(-b * x) - y, 2)) / 2 AS cost FROM g, bins GROUP BY 1)
 SELECT start_id, round(cost, 3) AS cost, row_number() OVER (ORDER BY cost, start_id)::INTEGER AS rank FROM c QUALIFY rank <= 5""")
def grid_search_topk(spark, d):
    """The five best of a grid of starting values: a top-k report."""
    s = frame.points(bins(spark, d), frame.Roles.of("x", "y"))
    thetas = np.array(GRID)
    c = search.population_costs(s, DECAY, thetas)[:, 0]
    return search.ranked(spark, thetas, c, DECAY.params).filter("rank <= 5").select("start_id", rnd("cost", 3).alias("cost"), "rank")


# ---- filters, checks ----

HOLES = "e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 13 = 0 THEN 'Infinity'::DOUBLE ELSE value END AS v FROM events)"


def holes(spark, d):
    v = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 11 == 0, float("nan")).when(F.col("event_id") % 13 == 0, float("inf")).otherwise(F.col("value"))
    return read(spark, d, "events").select("event_id", v.alias("v"))


@query(f"WITH {HOLES} SELECT event_id, v FROM e WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)")
def finite_filter(spark, d):
    return holes(spark, d).filter(frame.finite(F.col("v")))


@query(f"WITH {HOLES}, f AS (SELECT event_id::DOUBLE AS x, v AS y FROM e WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)) SELECT round(regr_slope(y, x), 9) AS a, round(regr_intercept(y, x), 6) AS b, count(*) AS n FROM f")
def nan_policy_omit(spark, d):
    f = curve_fit(holes(spark, d), "linear", "event_id", "v", nan_policy="omit")
    return values(spark, [(*f.popt.tolist(), f.outcome.state.n)], "a double, b double, n long").select(rnd("a", 9).alias("a"), rnd("b").alias("b"), "n")


@query(f"WITH {HOLES}, m AS (SELECT avg(v) AS m FROM e WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)) SELECT event_id, round(CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN m ELSE v END, 6) AS v FROM e, m")
def replace_by_mean(spark, d):
    h = holes(spark, d)
    return h.select("event_id", rnd(frame.replaced_by_mean(h, {"v": F.col("v")})["v"]).alias("v"))


@query("WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, value FROM events, q WHERE value < a - 3 * (b - a) OR value > b + 3 * (b - a)")
def iqr_outliers(spark, d):
    return frame.iqr_outliers(read(spark, d, "events"), "value").select("event_id", "value")


@query("WITH m AS (SELECT median(value) AS m FROM events), s AS (SELECT m, median(abs(value - m)) AS s FROM events, m GROUP BY m) SELECT event_id, value FROM events, s WHERE abs(value - m) > 5 * 1.4826 * s")
def mad_outliers(spark, d):
    return frame.mad_outliers(read(spark, d, "events"), "value").select("event_id", "value")


@query("SELECT (count(l_quantity) - count(DISTINCT l_quantity))::BIGINT AS n FROM lineitem")
def duplicate_x(spark, d):
    return values(spark, [(frame.duplicates(read(spark, d, "lineitem"), "l_quantity"),)], "n long")


DESCRIBED = ("l_quantity", "l_extendedprice", "l_discount")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in DESCRIBED))
def describe(spark, d):
    return frame.describe(read(spark, d, "lineitem"), list(DESCRIBED)).select("column", "n", "min", "max", rnd("mean", 4).alias("mean"), rnd("std", 4).alias("std"), "n_distinct")


PAIRS = ("l_quantity", "l_extendedprice", "twice")


@query("""WITH t AS (SELECT l_quantity, l_extendedprice, 2 * l_quantity + l_tax AS twice FROM lineitem), r AS (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM t
 UNION ALL SELECT 'l_quantity', 'twice', corr(l_quantity, twice) FROM t UNION ALL SELECT 'l_extendedprice', 'twice', corr(l_extendedprice, twice) FROM t) SELECT a, b, round(r, 8) AS r FROM r WHERE abs(r) > 0.95""")
def collinear_pairs(spark, d):
    t = read(spark, d, "lineitem").withColumn("twice", 2 * F.col("l_quantity") + F.col("l_tax"))
    return frame.collinear(t, list(PAIRS)).select("a", "b", rnd("r", 8).alias("r"))


FIM = "f AS (SELECT sum(l_quantity * l_quantity) AS p, sum(l_quantity) AS q, count(*)::DOUBLE AS r FROM lineitem), g AS (SELECT *, (p + r) / 2 AS m, sqrt(power((p - r) / 2, 2) + q * q) AS h FROM f)"


def _fim(spark, d):
    pts = frame.points(read(spark, d, "lineitem"), frame.Roles.of("l_quantity", "l_extendedprice"))
    return normal.unpacked(pts.agg(*normal.aggregates(normal.terms(MODELS["linear"], [0.0, 0.0]))).first(), [0.0, 0.0]).a


@query(f"WITH {FIM} SELECT round((m + h) / (m - h), 4) AS cond, 2 AS rank, round(q / sqrt(p * r), 8) AS corr FROM g")
def identifiability(spark, d):
    i = diagnose.identifiability(_fim(spark, d), corr_limit=0.5)
    return values(spark, [(i["cond"], i["rank"], i["pairs"][0][2])], "cond double, rank int, corr double").select(rnd("cond", 4).alias("cond"), "rank", rnd("corr", 8).alias("corr"))


@query(f"WITH {FIM} SELECT round(m + h, 2) AS largest, round(m - h, 2) AS smallest, round(log10((m + h) / (m - h)), 6) AS decades, round(power(2 * m, 2) / (power(m + h, 2) + power(m - h, 2)), 8) AS effective_dimension FROM g")
def fim_spectrum(spark, d):
    s = diagnose.sensitivity(_fim(spark, d))
    row = values(spark, [(float(s["eigenvalues"][0]), float(s["eigenvalues"][1]), s["decades"], s["effective_dimension"])], "largest double, smallest double, decades double, effective_dimension double")
    return row.select(rnd("largest", 2).alias("largest"), rnd("smallest", 2).alias("smallest"), rnd("decades").alias("decades"), rnd("effective_dimension", 8).alias("effective_dimension"))


@query(f"""WITH {BINS}, s AS (SELECT corr(x, y) AS r, arg_min(y, x) AS f, arg_max(y, x) AS l, min(y) AS lo, max(y) AS hi, min(x) AS x0, max(x) AS x1 FROM bins),
 t AS (SELECT (f - lo) / (hi - lo) AS a, (l - lo) / (hi - lo) AS b, (SELECT avg(y) FROM bins, s WHERE abs(x - (x0 + x1) / 2) < 0.1 * (x1 - x0)) AS m, * FROM s)
 SELECT CASE WHEN abs(r) > 0.99 THEN 'linear' WHEN a > 0.8 AND b < 0.2 THEN CASE WHEN (m - lo) / (hi - lo) BETWEEN 0.3 AND 0.7 THEN 'sigmoid_inv' ELSE 'decay' END ELSE 'other' END AS pattern FROM t""")
def function_pattern(spark, d):
    return values(spark, [(precision.pattern(bins(spark, d), "x", "y"),)], "pattern string")


@query("SELECT param::INTEGER AS param, round(p - greatest(abs(p) * 10, r), 6) AS lower, round(p + greatest(abs(p) * 10, r), 6) AS upper FROM (SELECT unnest([0, 1]) AS param, unnest([regr_slope(y, x), regr_intercept(y, x)]) AS p, greatest(max(y) - min(y), max(x) - min(x)) AS r FROM (SELECT floor(value / 10) * 10 + 5.0 AS x, count(*)::DOUBLE AS y FROM events WHERE value < 300 GROUP BY 1))")
def bounds_inference(spark, d):
    from ..functions.models import summary

    s = summary(bins(spark, d).withColumn("ord", F.col("x")))
    lo, hi = precision.infer_bounds([s["slope"], s["cut"]], s)
    return values(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lo, hi))], "param int, lower double, upper double").select("param", rnd("lower").alias("lower"), rnd("upper").alias("upper"))


@query("SELECT round(avg(z), 8) AS z, round(min(z), 8) AS low, round(max(z), 8) AS high, round(avg(-1 + 52 / (1 + exp(-z))), 6) AS x FROM (SELECT ln((l_quantity + 1) / (51.0 - l_quantity)) AS z FROM lineitem)")
def bounds_transform(spark, d):
    """Values between bounds to the whole line and back, block by block."""

    def run(pdfs):
        for pdf in pdfs:
            z = search.to_unbounded(pdf["x"].to_numpy(float), -1.0, 51.0)
            yield pd.DataFrame({"z": z, "x": search.to_bounded(z, -1.0, 51.0)})

    t = read(spark, d, "lineitem").select(F.col("l_quantity").alias("x")).mapInPandas(run, "z double, x double")
    return t.agg(rnd(F.avg("z"), 8).alias("z"), rnd(F.min("z"), 8).alias("low"), rnd(F.max("z"), 8).alias("high"), rnd(F.avg("x")).alias("x"))


# ---- chunks ----

CHUNKS = """c AS (SELECT l_orderkey % 8 AS k, count(*)::DOUBLE AS n, sum(l_quantity) AS sx, sum(l_quantity * l_quantity) AS sxx, regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem GROUP BY 1),
 s AS (SELECT c.k, n, sx, sxx, a, b, sum(power(l_extendedprice - a * l_quantity - b, 2)) / (n - 2) AS s2 FROM lineitem l JOIN c ON l.l_orderkey % 8 = c.k GROUP BY c.k, n, sx, sxx, a, b)"""


def _chunks(spark, d):
    return chunked.chunk_fits(read(spark, d, "lineitem"), "linear", "l_quantity", "l_extendedprice", F.col("l_orderkey") % 8, [1.0, 1.0])


@query(f"WITH {CHUNKS} SELECT k AS chunk_id, n::BIGINT AS n, round(a, 3) AS a, round(b, 3) AS b FROM s")
def chunk_fits(spark, d):
    return _chunks(spark, d).select("chunk_id", "n", rnd(F.col("theta")[0], 3).alias("a"), rnd(F.col("theta")[1], 3).alias("b"))


@query(f"""WITH {CHUNKS}, w AS (SELECT sum(sxx / s2) AS p, sum(sx / s2) AS q, sum(n / s2) AS r, sum((sxx * a + sx * b) / s2) AS u, sum((sx * a + n * b) / s2) AS v FROM s)
 SELECT round((r * u - q * v) / (p * r - q * q), 3) AS a, round((p * v - q * u) / (p * r - q * q), 3) AS b, round(r / (p * r - q * q), 6) AS var_a FROM w""")
def chunked_precision_merge(spark, d):
    theta, cov = chunked.merge(_chunks(spark, d))
    return values(spark, [(*theta.tolist(), float(cov[0, 0]))], "a double, b double, var_a double").select(rnd("a", 3).alias("a"), rnd("b", 3).alias("b"), rnd("var_a").alias("var_a"))


# ---- sampling ----


@query("""WITH RECURSIVE p AS (SELECT o_orderkey AS id, b, o_orderkey AS n, 1.0::DOUBLE AS f, 0.0::DOUBLE AS s FROM orders, (VALUES (2), (3), (5)) q(b)
 UNION ALL SELECT id, b, n // b, f / b, s + f / b * (n % b) FROM p WHERE n > 0)
 SELECT id, round(max(s) FILTER (b = 2), 10) AS h1, round(max(s) FILTER (b = 3), 10) AS h2, round(max(s) FILTER (b = 5), 10) AS h3 FROM p GROUP BY id""")
def halton_points(spark, d):
    """Halton coordinates by the keys of orders."""
    t = search.halton_table(read(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", 3)
    return t.select("id", *(rnd(f"h{i}", 10).alias(f"h{i}") for i in (1, 2, 3)))


@query("SELECT i::INTEGER AS stratum, 3 AS n FROM range(64) t(i)")
def lhs_stratified_check(spark, d):
    u = search.latin_hypercube(64, 3, 42)
    rows = values(spark, [(int(x),) for x in np.floor(u * 64).ravel()], "stratum int")
    return rows.groupBy("stratum").agg(F.count("*").cast("int").alias("n"))


def decay_box(s: DataFrame) -> tuple:
    """Bounds of DECAY for a search. Counts grow with the table, so the amplitude's bound does once 1e6 would cut it off."""
    return [0.0, 1e-3], [max(1e6, 2.0 * (s.agg(F.max("y")).first()[0] or 0.0)), 1.0]


@query(ORACLE["exp_decay_fit"].replace("round(a, 4)", "round(a, 2)").replace("round(b, 8)", "round(b, 6)"), "tournament_fit")
def _tournament(spark, d):
    s = bins(spark, d)
    f, _ = search.tournament(s, DECAY, "x", "y", decay_box(s))
    return values(spark, [tuple(f.popt.tolist())], "a double, b double").select(rnd("a", 2).alias("a"), rnd("b", 6).alias("b"))


@query(ORACLE["exp_decay_fit"].replace("round(a, 4)", "round(a, 2)").replace("round(b, 8)", "round(b, 6)"), "multi_start_fit")
def _multi_start(spark, d):
    s = bins(spark, d)
    f = search.multi_start(s, DECAY, "x", "y", decay_box(s), n_starts=32)
    return values(spark, [tuple(f.popt.tolist())], "a double, b double").select(rnd("a", 2).alias("a"), rnd("b", 6).alias("b"))


@query(ORACLE["exp_decay_fit"].replace("round(a, 4)", "round(a, 2)").replace("round(b, 8)", "round(b, 6)"), "cma_es_fit")
def _cma_es(spark, d):
    s = bins(spark, d)
    f = search.cma_es(s, DECAY, "x", "y", decay_box(s), preset="fast")
    return values(spark, [tuple(f.popt.tolist())], "a double, b double").select(rnd("a", 2).alias("a"), rnd("b", 6).alias("b"))


@query(ORACLE["exp_decay_fit"].replace("round(a, 4)", "round(a, 2)").replace("round(b, 8)", "round(b, 6)"), "hybrid_decay_fit")
def _hybrid(spark, d):
    s = bins(spark, d)
    f = hybrid_fit(s, DECAY, "x", "y", p0=[s.agg(F.max("y")).first()[0] / 2, 0.05])
    return values(spark, [tuple(f.popt.tolist())], "a double, b double").select(rnd("a", 2).alias("a"), rnd("b", 6).alias("b"))


@query(ORACLE["exp_decay_fit"].replace("round(a, 4)", "round(a, 2)").replace("round(b, 8)", "round(b, 6)"), "auto_global_fit")
def _auto_global(spark, d):
    s = bins(spark, d)
    f = workflows.fit(s, DECAY, "x", "y", "auto_global", bounds=decay_box(s), preset="fast")
    return values(spark, [tuple(f.popt.tolist())], "a double, b double").select(rnd("a", 2).alias("a"), rnd("b", 6).alias("b"))


def _line(x, a, b):
    return a * x + b


def _line_slopes(x, a, b):
    return np.stack([x, np.ones_like(x)], 1)


@query(ORACLE["linear_fit"])
def numeric_model_fit(spark, d):
    """A model and derivatives given as numpy functions."""
    f = curve_fit(read(spark, d, "lineitem"), Numeric("line", _line, ("a", "b"), jac=_line_slopes), "l_quantity", "l_extendedprice", p0=[1.0, 1.0])
    return values(spark, list(f.params.items()), "param string, value double").select("param", rnd("value", 4).alias("value"))


@query("SELECT round(sum(power(l_extendedprice - 900 * l_quantity - 1000, 2) / l_linenumber) / sum(1.0::DOUBLE / l_linenumber), 1) AS loss FROM lineitem", "group_weighted_loss")
def _group_weighted(spark, d):
    got = correlated.group_weighted_loss(read(spark, d, "lineitem"), "linear", "l_quantity", "l_extendedprice", [900.0, 1000.0], "l_linenumber", {i: 1 / i for i in range(1, 8)})
    return values(spark, [(got,)], "loss double").select(rnd("loss", 1).alias("loss"))


# ---- histories: each user's events in order stand for a history of costs ----

HISTORY = "h AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration, value AS cost FROM events)"


def history(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events").select("user_id", F.row_number().over(w).cast("long").alias("iteration"), F.col("value").alias("cost"))


@query(f"""WITH {HISTORY} SELECT user_id, iteration, round(sqrt(var_pop(cost) OVER w), 6) AS std5, round(avg(cost) OVER w, 6) AS mean5, min(cost) OVER (PARTITION BY user_id ORDER BY iteration) AS best
 FROM h WINDOW w AS (PARTITION BY user_id ORDER BY iteration ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def convergence_windows(spark, d):
    return diagnose.windows(history(spark, d), ["user_id"]).select("user_id", "iteration", rnd(F.sqrt("var5")).alias("std5"), rnd("mean5").alias("mean5"), "best")


@query(f"""WITH {HISTORY}, d AS (SELECT *, cost - lag(cost) OVER w AS dc FROM h WINDOW w AS (PARTITION BY user_id ORDER BY iteration)),
 f AS (SELECT *, CASE WHEN sign(dc) * sign(lag(dc) OVER w) < 0 THEN 1 ELSE 0 END AS flip, row_number() OVER (PARTITION BY user_id ORDER BY iteration DESC) AS r FROM d WINDOW w AS (PARTITION BY user_id ORDER BY iteration)),
 m AS (SELECT user_id, count(*) AS n, sum(CASE WHEN r <= 8 THEN flip ELSE 0 END) AS flips, avg(cost) FILTER (r <= 5) AS m5, avg(cost) FILTER (r BETWEEN 6 AND 10) AS p5, regr_slope(ln(abs(cost) + 1e-10), iteration) AS slope FROM f GROUP BY 1)
 SELECT user_id, n, flips / greatest(least(n, 10) - 2.0, 1.0) > 0.7 AS oscillating, coalesce(m5 / p5 > 1.5, false) AS diverging, round(-slope, 6) AS rate FROM m""")
def convergence_flags(spark, d):
    return diagnose.convergence(history(spark, d), by=["user_id"]).select("user_id", "n", "oscillating", "diverging", rnd("rate").alias("rate"))


@query("SELECT event_type AS param, count(*) AS n, round(avg(abs(value - 50)), 6) AS mean, round(var_samp(abs(value - 50)), 4) AS var FROM events GROUP BY 1")
def gradient_stats(spark, d):
    g = read(spark, d, "events").select(F.col("event_type").alias("param"), F.col("event_id").alias("iteration"), (F.col("value") - 50).alias("g"))
    return diagnose.gradient_stats(g).select("param", "n", rnd("mean").alias("mean"), rnd("var", 4).alias("var"))


@query(f"""WITH {LINE}, r AS (SELECT l_extendedprice - a * l_quantity - b AS r FROM lineitem, line), s AS (SELECT min(r) AS lo, (max(r) - min(r)) / 20 AS w FROM r)
 SELECT least(floor((r - lo) / w), 19)::INTEGER AS bin, count(*) AS n FROM r, s GROUP BY 1""")
def histogram_residuals(spark, d):
    return price_on_quantity(spark, d).residual_histogram(20).select("bin", "n")


# ---- streams ----


@query("SELECT round(regr_slope(value, hour(ts)), 6) AS a, round(regr_intercept(value, hour(ts)), 6) AS b, count(*) AS n FROM events")
def streaming_incremental_linear(spark, d):
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp()
    stream = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/event[s].parquet").withColumn("hour", F.hour("ts"))
    inc = Incremental("linear", "hour", "value")
    inc.start(stream, f"{base}/stream-{uuid.uuid4().hex}").awaitTermination()
    return values(spark, [(*inc.solve().tolist(), inc.n)], "a double, b double, n long").select(rnd("a").alias("a"), rnd("b").alias("b"), "n")


@query("SELECT date_trunc('day', ts) AS day, event_type, round(regr_slope(value, event_id), 8) AS slope, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_linear_fit(spark, d):
    w = windowed_linear(read(spark, d, "events"), "ts", "event_id", "value", "1 day", keys=("event_type",))
    return w.select(F.col("window.start").alias("day"), "event_type", rnd("slope", 8).alias("slope"), "n")


@query("SELECT name, type FROM (VALUES ('a', 'parameter'), ('b', 'parameter'), ('n', 'statistic'), ('r2', 'statistic'), ('adj_r2', 'statistic'), ('rmse', 'statistic'), ('mae', 'statistic'), ('aic', 'statistic'), ('bic', 'statistic'), ('chi2', 'statistic'), ('success', 'convergence'), ('message', 'convergence'), ('status', 'convergence'), ('nfev', 'convergence'), ('nit', 'convergence'), ('optimality', 'convergence')) t(name, type)")
def export_rows(spark, d):
    return writers.rows(price_on_quantity(spark, d)).select("name", "type")
