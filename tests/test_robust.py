"""Fits that fail without guards, rescaled data, several starts or fallbacks, and pass with them; quantiles and neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitloom.functions.models import formula, polynomial
from fitloom.operators import frame, precision, robust, solve
from fitloom.operators.fit import curve_fit

DECAY = formula("p*exp(-q*x) + r", ("p", "q", "r"))


def table(spark, f, lo=0.0, hi=10.0, n=300, noise=0.02, seed=0):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(float(x), float(f(x) + noise * r.normal())) for x in np.linspace(lo, hi, n)], "x double, y double").cache()


@pytest.mark.parametrize("local", [0, 50_000])
def test_overflow_is_guarded(spark, local):
    df = table(spark, lambda x: 4 * np.exp(-0.1 * x) + 1, 1, 50, 50)
    with pytest.raises(ValueError, match="not finite"):
        curve_fit(df, DECAY, "x", "y", p0=[4.0, -20.0, 1.0], local_rows=local)
    with pytest.raises(ValueError, match="leave 1e"):  # guarded, it goes on, to a place where values are cut
        curve_fit(df, DECAY, "x", "y", p0=[4.0, -20.0, 1.0], stability="auto", local_rows=local)
    got = curve_fit(df, DECAY, "x", "y", p0=[4.0, -20.0, 1.0], stability="auto", fallback=True, local_rows=local)
    want = curve_fit(df, DECAY, "x", "y", p0=[4.0, 0.1, 1.0])
    np.testing.assert_allclose(got.popt, want.popt, rtol=1e-4)


def test_results_of_rescaled_data_are_turned_back(spark):
    far, near = 3e5, 50.0
    df = table(spark, lambda x: 3 * ((x - far) / near) ** 2 - ((x - far) / near) + 2, far, far + near)
    want = curve_fit(df.withColumn("x", (F.col("x") - far) / near), polynomial(2), "x", "y")
    plain = curve_fit(df, polynomial(2), "x", "y")
    got = curve_fit(df, polynomial(2), "x", "y", stability="auto")
    assert abs(got.popt[0] * near**2 / want.popt[0] - 1) < 1e-6 < abs(plain.popt[0] * near**2 / want.popt[0] - 1)
    assert abs(got.stderr["c0"] * near**2 / want.stderr["c0"] - 1) < 1e-4 and any("x scaled" in n for n in got.notes)
    peak = table(spark, lambda x: 5 * np.exp(-((x - 1000.5) ** 2) / 0.08), 1000, 1001)
    got, want = robust.rescaled_fit(peak, "gaussian", "x", "y"), curve_fit(peak, "gaussian", "x", "y", p0=[5.0, 1000.5, 0.2])
    np.testing.assert_allclose(got.popt, want.popt, rtol=1e-6)
    np.testing.assert_allclose(got.pcov, want.pcov, rtol=1e-3, atol=1e-12)
    assert abs(got.outcome.state.ssr / want.outcome.state.ssr - 1) < 1e-6 and got.intervals().count() == 3
    late = table(spark, lambda x: 4 * np.exp(-0.5 * (x - 40)) + 1, 40, 50)
    got, want = robust.rescaled_fit(late, DECAY, "x", "y"), curve_fit(late.withColumn("x", F.col("x") - 40), DECAY, "x", "y", p0=[4.0, 0.5, 1.0])
    np.testing.assert_allclose([got.popt[0] * np.exp(-40 * got.popt[1]), *got.popt[1:]], want.popt, rtol=1e-5)
    with pytest.raises(ValueError, match="turned back"):
        robust.rescaled_fit(late, "a*exp(-b*x*x)", "x", "y")
    with pytest.raises(ValueError, match="bounds"):
        robust.rescaled_fit(late, "a*x + b", "x", "y", bounds=([0, 0], [1, 1]))
    with pytest.raises(ValueError, match="no finite rows"):
        robust.rescaled_fit(late.limit(0), "a*x + b", "x", "y")


def test_weights_are_kept_by_rescaled_fits(spark):
    df = table(spark, lambda x: 2 * x + 1, 1e6, 1e6 + 100).withColumn("s", 0.1 + F.pmod(F.col("x"), F.lit(3)))
    a = robust.rescaled_fit(df, "linear", "x", "y", sigma="s", absolute_sigma=True)
    b = curve_fit(df.withColumn("x", F.col("x") - 1e6), "linear", "x", "y", sigma="s", absolute_sigma=True)
    assert abs(a.popt[0] / b.popt[0] - 1) < 1e-8 and abs(a.stderr["a"] / b.stderr["a"] - 1) < 1e-6
    assert abs(a.outcome.state.cost / b.outcome.state.cost - 1) < 1e-6


def test_one_call_checks_falls_back_and_starts_often(spark):
    df = table(spark, lambda x: 4 * np.exp(-0.5 * x) + 1)
    with pytest.raises(ValueError, match="not finite"):
        curve_fit(df, DECAY, "x", "y", p0=[1.0, -900.0, 1.0])
    got = curve_fit(df, DECAY, "x", "y", p0=[1.0, -900.0, 1.0], fallback=True)
    assert got.outcome.success and any(n.startswith("fallback: ") for n in got.notes)
    limited = curve_fit(df, DECAY, "x", "y", p0=[1.0, 1.0, 0.0], max_nfev=2)
    assert not limited.outcome.success
    several = curve_fit(df, DECAY, "x", "y", bounds=([0, 0, -5], [10, 5, 5]), multistart=5)
    np.testing.assert_allclose(several.popt, [4, 0.5, 1], atol=0.05)
    with pytest.raises(ValueError, match="finite bounds"):
        curve_fit(df, DECAY, "x", "y", multistart=5)
    with pytest.raises(ValueError, match="not below"):
        curve_fit(df, DECAY, "x", "y", p0=[1, 1, 1], bounds=([0, 5, 0], [1, 2, 3]), stability="check")
    with pytest.raises(ValueError, match="cannot determine"):
        curve_fit(df.limit(2), DECAY, "x", "y", p0=[1, 1, 1], stability="check")
    with pytest.raises(ValueError, match="unknown stability"):
        curve_fit(df, DECAY, "x", "y", stability="always")
    noted = curve_fit(df, DECAY, "x", "y", p0=[1.0, 1e-9, 1.0], stability="check")
    assert any("starting values differ" in n for n in noted.notes)


def test_parameters_without_influence_get_a_ridge(spark):
    df = table(spark, lambda x: 2 * x)
    got = curve_fit(df, "a*x + b*(abs(x) - x)", "x", "y", p0=[1.0, 3.0], stability="auto")
    assert abs(got.popt[0] - 2) < 0.01 and got.popt[1] == 3.0 and got.notes


def test_steps_survive_a_failed_decomposition(monkeypatch):
    r = np.random.default_rng(0)
    m, g = r.normal(size=(20, 4)), r.normal(size=4)
    want = solve.Dense(m.T @ m, g).step(np.inf)[0]

    def fail(*a):
        raise np.linalg.LinAlgError

    monkeypatch.setattr(solve, "trust_step", fail)
    s, bent = solve.Dense(m.T @ m, g).step(np.inf)
    np.testing.assert_allclose(s, want, rtol=1e-9)
    np.testing.assert_allclose(bent, m.T @ m @ s)
    assert abs(np.linalg.norm(solve.Dense(m.T @ m, g).step(0.01)[0]) - 0.01) < 1e-12


@pytest.mark.parametrize("collect", [3, 10_000])
def test_quantiles_in_one_pass_a_level(spark, collect):
    r = np.random.default_rng(1)
    v = np.concatenate([r.normal(size=400), [1.5] * 300, [-1e9, 1e9, 7.0, 7.0]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),), (float("inf"),)], "v double").repartition(5)
    shares = [0.0, 0.01, 0.25, 0.5, 0.5, 0.75, 0.99, 1.0]
    np.testing.assert_allclose(frame.quantiles(df, F.col("v"), shares, collect), np.quantile(v, shares), rtol=1e-12)
    assert frame.quantiles(df.limit(0), F.col("v"), [0.5]) == [None]
    assert frame.quantiles(df.filter("v = 7"), F.col("v"), [0.0, 0.3]) == [7.0, 7.0]


def test_neighbours_of_repeated_rows(spark):
    r = np.random.default_rng(2)
    data = sorted((float(x), float(y)) for x, y in zip(r.integers(0, 5, 200), r.normal(size=200))) + [(9.0, 1.0)] * 50
    got = precision.neighbours(spark.createDataFrame(data, "x double, y double").repartition(4), "x", "y").collect()
    want = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(sorted(data), sorted(data)[1:])]
    assert sorted((x.dx, x.dy) for x in got) == sorted(want)
