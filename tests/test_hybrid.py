import json

import numpy as np
import pandas as pd
import pytest

from fitloom.functions.models import MODELS, formula
from fitloom.functions.numeric import Numeric
from fitloom.operators import correlated, hybrid
from fitloom.operators.fit import curve_fit
from fitloom.plans.workflows import fit

X = np.linspace(0.1, 4, 90)


def decay(spark, seed=0, noise=0.02):
    y = 2.5 * np.exp(-1.3 * X) + 0.1 + np.random.default_rng(seed).normal(0, noise, len(X))
    return spark.createDataFrame(pd.DataFrame({"t": X, "z": y}))


@pytest.mark.parametrize("preset", sorted(hybrid.PRESETS))
def test_hybrid_finds_the_same_minimum_from_afar(spark, preset):
    df = decay(spark)
    want = curve_fit(df, "exponential_decay", "t", "z")
    got = hybrid.hybrid_fit(df, "exponential_decay", "t", "z", p0=[20, 4, -3], settings=preset)
    np.testing.assert_allclose(got.popt, want.popt, rtol=1e-5)
    np.testing.assert_allclose(got.pcov, want.pcov, rtol=1e-4)
    costs = [h["cost"] for h in got.outcome.history]
    assert costs[-1] < costs[0] and got.outcome.success


def test_hybrid_state_can_be_resumed(spark):
    df, states = decay(spark), []
    full = hybrid.hybrid_fit(df, "exponential_decay", "t", "z", p0=[10, 3, 0], bounds=([0, 0, -1], [50, 10, 5]), keep=states.append)
    assert json.loads(states[-1])["phase"] == "done"
    again = hybrid.hybrid_fit(df, "exponential_decay", "t", "z", bounds=([0, 0, -1], [50, 10, 5]), resume=states[0])
    np.testing.assert_allclose(again.popt, full.popt, rtol=1e-6)


def test_group_variance_pulls_parameters_together(spark):
    df = spark.createDataFrame(pd.DataFrame({"u": [1.0, 0.0] * 20, "v": [0.0, 1.0] * 20, "z": [1.0, 3.0] * 20}))
    m = formula("a*u + b*v", ("a", "b"), ("u", "v"))
    free = hybrid.hybrid_fit(df, m, ["u", "v"], "z", p0=[0.5, 0.5])
    held = hybrid.hybrid_fit(df, m, ["u", "v"], "z", p0=[0.5, 0.5], penalty=hybrid.GroupVariance(((0, 2),), 100.0))
    np.testing.assert_allclose(free.popt, [1, 3], rtol=1e-6)
    assert abs(held.popt[1] - held.popt[0]) < 0.02
    c, g, h = hybrid.GroupVariance(((0, 2),), 2.0).terms(np.array([1.0, 4.0]), 5)
    assert np.isclose(c, 2 * 5 * 2.25)
    step = 1e-6
    up = hybrid.GroupVariance(((0, 2),), 2.0).terms(np.array([1.0 + step, 4.0]), 5)
    np.testing.assert_allclose([(up[0] - c) / step, *((up[1] - g) / step)], [g[0], *h[0]], rtol=1e-4)


def test_numeric_models_and_given_derivatives(spark):
    df = decay(spark)
    want = curve_fit(df, "exponential_decay", "t", "z")
    f = lambda x, a, b, c: a * np.exp(-b * x) + c
    jac = lambda x, a, b, c: np.stack([np.exp(-b * x), -a * x * np.exp(-b * x), np.ones_like(x)], 1)
    for j in (None, jac):
        for rows in (50_000, 0):
            got = curve_fit(df, Numeric("decay", f, ("a", "b", "c"), jac=j), "t", "z", p0=[1, 1, 0], local_rows=rows, ftol=1e-9, xtol=1e-9, gtol=1e-6)
            np.testing.assert_allclose(got.popt, want.popt, rtol=1e-5)
    assert abs(got.stats()["r2"] - want.stats()["r2"]) < 1e-9
    a, b = (r.predict().toPandas().sort_values("v_x") for r in (got, want))
    np.testing.assert_allclose(a[["y_hat", "lower", "upper"]], b[["y_hat", "lower", "upper"]], rtol=1e-4)
    given = formula("a*exp(-b*x) + c", ("a", "b", "c"), jac=("exp(-b*x)", "-a*x*exp(-b*x)", "1"))
    np.testing.assert_allclose(curve_fit(df, given, "t", "z", p0=[1, 1, 0]).popt, want.popt, rtol=1e-6)


def test_correlated_errors_agree_with_the_closed_form(spark):
    r, rows, a, b = np.random.default_rng(3), [], np.zeros((2, 2)), np.zeros(2)
    for k in range(6):
        n = 3 + k
        m = r.normal(size=(n, n))
        cov = m @ m.T + np.eye(n)
        x = r.uniform(0, 5, n)
        y = 2 * x + 1 + np.linalg.cholesky(cov) @ r.normal(size=n)
        j = np.column_stack([x, np.ones(n)])
        a += j.T @ np.linalg.solve(cov, j)
        b += j.T @ np.linalg.solve(cov, y)
        rows += [(f"b{k}", i, float(x[i]), float(y[i]), cov[i].tolist()) for i in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame([tuple(x) for x in rows], "g string, i int, t double, z double, c array<double>").repartition(3)
    got = correlated.correlated_fit(df, "linear", "t", "z", "g", "c", "i")
    np.testing.assert_allclose(got.popt, np.linalg.solve(a, b), rtol=1e-7)
    np.testing.assert_allclose(got.pcov, np.linalg.inv(a), rtol=1e-7)


def test_workflows(spark):
    df = decay(spark)
    want = curve_fit(df, "exponential_decay", "t", "z").popt
    bounds = ([0, 0, -1], [10, 10, 1])
    for more in ({}, {"goal": "quality"}, {"goal": "robust"}, {"workflow": "auto_global", "bounds": bounds}, {"workflow": "hpc"}):
        np.testing.assert_allclose(fit(df, "exponential_decay", "t", "z", **more).popt, want, rtol=0.05 if more.get("goal") == "robust" else 1e-4)
    for bad in ({"workflow": "other"}, {"goal": "other"}, {"workflow": "auto_global"}):
        with pytest.raises(ValueError):
            fit(df, "exponential_decay", "t", "z", **bad)


def test_starting_values_and_bounds_from_the_data(spark):
    df = decay(spark)
    m = formula("a*exp(-b*x) + c", ("a", "b", "c"))
    np.testing.assert_allclose(curve_fit(df, m, "t", "z", p0="auto", auto_bounds=True).popt, curve_fit(df, MODELS["exponential_decay"], "t", "z").popt, rtol=1e-5)


def test_group_weighted_loss(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1), (2.0, 5.0, 2), (3.0, 9.0, 3)], "t double, z double, k int")
    got = correlated.group_weighted_loss(df, "linear", "t", "z", [2.0, 0.0], "k", {1: 1.0, 2: 3.0})
    assert np.isclose(got, (1 * 0 + 3 * 1) / 4)
