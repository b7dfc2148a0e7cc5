import io
import json

import numpy as np
import pandas as pd
import pytest

from fitloom.functions.models import MODELS, formula
from fitloom.operators import callbacks, chunked, diagnose, precision, search, solve, stability
from fitloom.operators.fit import curve_fit, covariance
from fitloom.operators.frame import Roles, points, validate
from fitloom.operators.grouped import fit_by_key
from fitloom.operators.normal import Problem
from fitloom.plans.planner import plan

X = np.linspace(0.1, 4, 120)
TRUTH = {
    "linear": (2, 1), "exponential_decay": (2.5, 1.3, 0.1), "exponential_growth": (1.2, 0.5, 0.3), "gaussian": (1.5, 2, 0.6),
    "lorentzian": (2, 1.7, 0.4), "sigmoid": (3, 2, 2.5, 0.5), "power_law": (2, 1.5), "polynomial_3": (0.3, 1, -2, 0.5),
}


def frame_of(spark, y, x=X, **more):
    return spark.createDataFrame(pd.DataFrame({"t": x, "z": np.broadcast_to(y, np.shape(x)), **more}))


@pytest.mark.parametrize("name", sorted(TRUTH))
def test_exact_recovery(spark, name):
    y = MODELS[name].numpy()(TRUTH[name], {"x": X})
    f = curve_fit(frame_of(spark, y), name, "t", "z")
    np.testing.assert_allclose(f.popt, TRUTH[name], atol=1e-8)
    assert f.outcome.success


def noisy(seed=0, outliers=False):
    r = np.random.default_rng(seed)
    y = 2.5 * np.exp(-1.3 * X) + 0.1 + r.normal(0, 0.02, len(X))
    if outliers:
        y[::12] += 4
    return y


def test_aggregates_agree_with_blocks_and_triangle(spark):
    df = frame_of(spark, noisy(), s=0.5 + X)
    m = MODELS["exponential_decay"]
    pts = points(df, Roles.of("t", "z", sigma="s"))
    for which in ("linear", "soft_l1", "huber", "cauchy", "arctan"):
        a, b = Problem(pts, m, which, 0.1), Problem(pts.repartition(5), m, which, 0.1, local_rows=0)
        u, v = a([2.0, 1.0, 0.2]), b([2.0, 1.0, 0.2])
        w = b.by_blocks(np.array([2.0, 1.0, 0.2]))
        for x in (v, w):
            np.testing.assert_allclose([u.cost, u.ssr, u.n], [x.cost, x.ssr, x.n], rtol=1e-12)
            np.testing.assert_allclose(u.a, x.a, rtol=1e-10)
            np.testing.assert_allclose(u.g, x.g, rtol=1e-9)
        r = b.triangle([2.0, 1.0, 0.2])
        np.testing.assert_allclose(r[:3, :3].T @ r[:3, :3], u.a, rtol=1e-10)


def test_distributed_fit_equals_local_and_is_invariant(spark):
    df = frame_of(spark, noisy())
    a = curve_fit(df, "exponential_decay", "t", "z")
    b = curve_fit(df.repartition(7), "exponential_decay", "t", "z", p0=a.popt * 1.1, local_rows=0)
    np.testing.assert_allclose(a.popt, b.popt, rtol=1e-6)
    np.testing.assert_allclose(a.pcov, b.pcov, rtol=1e-5)
    scaled = curve_fit(frame_of(spark, 10 * noisy()), "exponential_decay", "t", "z")
    np.testing.assert_allclose(scaled.popt, a.popt * [10, 1, 10], rtol=1e-6)


def test_robust_loss_resists_outliers(spark):
    f = curve_fit(frame_of(spark, noisy(outliers=True)), "exponential_decay", "t", "z", loss="cauchy", f_scale=0.05, p0=[2, 1, 0])
    np.testing.assert_allclose(f.popt, [2.5, 1.3, 0.1], atol=0.1)


def test_bounds_hold(spark):
    f = curve_fit(frame_of(spark, noisy()), "exponential_decay", "t", "z", bounds=([0, 0, 0], [2, 5, 1]), p0=[1, 1, 0.5])
    assert (f.popt <= [2, 5, 1]).all() and f.popt[0] > 1.999
    with pytest.raises(ValueError):
        curve_fit(frame_of(spark, noisy()), "linear", "t", "z", bounds=([1, 1], [0, 2]))


def test_results(spark):
    f = curve_fit(frame_of(spark, 2 * X + 1 + np.random.default_rng(1).normal(0, 0.1, len(X))), "linear", "t", "z")
    c = np.polyfit(X, f.points.toPandas().sort_values("v_x").y, 1, cov=True)
    np.testing.assert_allclose(f.popt, c[0], rtol=1e-9)
    np.testing.assert_allclose(f.pcov, c[1], rtol=1e-7)
    p = f.predict(exact=True).toPandas()
    assert ((p.lower <= p.y_hat) & (p.pred_lower < p.lower)).all()
    assert f.residual_histogram(10).toPandas().n.sum() == len(X)
    assert f.to_df().first().success and f.history().count() >= 1
    popt, pcov = f
    assert popt is f.popt and pcov is f.pcov


def test_missing_values_masks_and_validation(spark):
    y = (2 * X + 1).copy()
    y[3] = np.nan
    df = frame_of(spark, y, keep=np.arange(len(X)) > 5, s=1.0)
    with pytest.raises(ValueError):
        curve_fit(df, "linear", "t", "z")
    np.testing.assert_allclose(curve_fit(df, "linear", "t", "z", nan_policy="omit").popt, [2, 1])
    np.testing.assert_allclose(curve_fit(df, "linear", "t", "z", mask="keep").popt, [2, 1])
    v = validate(df, Roles.of("t", "z", sigma="s"))
    assert v["errors"] and v["n"] == len(X)
    with pytest.raises(ValueError):
        curve_fit(frame_of(spark, X[:1], X[:1]), "linear", "t", "z", p0=[1, 1])


def test_two_predictors(spark):
    r = np.random.default_rng(2)
    u, v = r.uniform(-1, 1, 300), r.uniform(-1, 1, 300)
    m = MODELS["gaussian_2d"]
    t = (2, 0.1, -0.2, 0.5, 0.7, 0.3)
    df = spark.createDataFrame(pd.DataFrame({"u": u, "v": v, "z": m.numpy()(t, {"x": u, "y": v})}))
    f = curve_fit(df, m, ["u", "v"], "z", p0=[1.5, 0, 0, 0.6, 0.6, 0.2])
    np.testing.assert_allclose(f.popt, t, atol=1e-7)


def test_fit_by_key_small_and_large(spark):
    rows = pd.concat([pd.DataFrame({"k": k, "t": X, "z": k * np.exp(-0.5 * k * X) + 0.1}) for k in (1, 2, 3)])
    rows = pd.concat([rows, pd.DataFrame({"k": 9, "t": [1.0], "z": [1.0]})])
    df = spark.createDataFrame(rows)
    for limit in (10, 100_000):
        got = {r.k: r for r in fit_by_key(df, "exponential_decay", "t", "z", ["k"], [1.0, 1.0, 0.0], group_rows=limit).collect()}
        for k in (1, 2, 3):
            np.testing.assert_allclose(got[k].params, [k, 0.5 * k, 0.1], atol=1e-6)
        assert not got[9].success and got[9].error


def test_chunks_merge_to_the_whole(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    df = frame_of(spark, 2 * X + 1 + r.normal(0, 0.1, len(X)), i=np.arange(len(X)), s=0.1)
    whole = curve_fit(df, "linear", "t", "z", sigma="s", absolute_sigma=True)
    fits = chunked.chunk_fits(df, "linear", "t", "z", F.col("i") % 4, [1, 1], sigma="s")
    theta, cov = chunked.merge(fits)
    np.testing.assert_allclose(theta, whole.popt, rtol=1e-9)
    np.testing.assert_allclose(cov, whole.pcov, rtol=1e-9)
    assert chunked.failures(fits).count() == 0


def test_samplers():
    u = search.latin_hypercube(32, 4, 1)
    assert (np.sort(np.floor(u * 32), axis=0) == np.arange(32)[:, None]).all()
    np.testing.assert_allclose(search.halton(4, 2), [[1 / 2, 1 / 3], [1 / 4, 2 / 3], [3 / 4, 1 / 9], [1 / 8, 4 / 9]])
    s = search.sobol(64, 21)
    for d in range(21):
        assert sorted(np.floor(s[:, d] * 64)) == list(range(64))
    z = search.to_unbounded(np.array([0.2, 5.0]), np.array([0.0, -np.inf]), np.array([1.0, np.inf]))
    np.testing.assert_allclose(search.to_bounded(z, np.array([0.0, -np.inf]), np.array([1.0, np.inf])), [0.2, 5.0])


def test_global_searches_find_the_same_minimum(spark):
    df = frame_of(spark, noisy())
    bounds = ([0, 0, -1], [10, 10, 1])
    want = curve_fit(df, "exponential_decay", "t", "z").popt
    np.testing.assert_allclose(search.multi_start(df, "exponential_decay", "t", "z", bounds, 16).popt, want, rtol=1e-5)
    np.testing.assert_allclose(search.cma_es(df, "exponential_decay", "t", "z", bounds, preset="fast").popt, want, rtol=1e-5)
    fit, survivors = search.tournament(df, "exponential_decay", "t", "z", bounds, 16, rounds=3)
    np.testing.assert_allclose(fit.popt, want, rtol=1e-5)
    assert survivors == [8, 4, 2]
    assert search.method([0, 0], [1, 1e5]) == "cma_es"
    m = MODELS["exponential_decay"]
    pts = points(df, Roles.of("t", "z"))
    thetas = np.array([[2.0, 1, 0], [1, 1, 1]])
    np.testing.assert_allclose(search.population_costs(pts, m, thetas)[:, 0], [Problem(pts, m)(t).cost for t in thetas], rtol=1e-12)


def test_diagnostics(spark):
    df = frame_of(spark, noisy())
    f = curve_fit(df, "exponential_decay", "t", "z")
    h = diagnose.health(f)
    assert 0 <= h["score"] <= 1
    bad = diagnose.identifiability(np.array([[1.0, 1.0], [1.0, 1.0]]))
    assert bad["rank"] == 1 and bad["issues"][0].code == "IDENT-001"
    assert diagnose.issues_df(spark, bad["issues"]).count() == 2
    s = diagnose.sensitivity(np.diag([1e8, 1.0, 1e-2]))
    assert s["sloppy"] == [1, 2] and 1 <= s["effective_dimension"] < 1.001
    rows = spark.createDataFrame([(i, float(5 + (-1) ** i)) for i in range(12)], "iteration int, cost double")
    flags = diagnose.convergence(rows).first()
    assert flags.oscillating and not flags.stagnant
    flat = spark.createDataFrame([(i, 1.0) for i in range(12)], "iteration int, cost double")
    assert diagnose.convergence(flat).first().stagnant
    assert diagnose.gradient_health([1] + [1e-9] * 12, [1.0] * 13)["issues"][0].code == "GRAD-001"
    diagnose.register("broken", lambda r: 1 / 0)
    assert any(i.code == "PLUGIN" for i in diagnose.health(f)["issues"])
    diagnose.PLUGINS.clear()


def test_precision_and_stability(spark):
    df = frame_of(spark, noisy(outliers=True))
    a = precision.analyse(df, "t", "z")
    assert a["n"] == len(X) and a["uniform"] and precision.choose(a)["loss"] != "linear"
    assert precision.pattern(frame_of(spark, 3 * X), "t", "z") == "linear"
    assert precision.pattern(frame_of(spark, np.exp(-((X - 2) ** 2) * 4)), "t", "z") == "gaussian"
    assert precision.tolerance(10) == 1e-12 and precision.tolerance(10**9) == 1e-6 or precision.tolerance(10**9) <= 1e-5
    n = precision.Normalizer([1, 2], [0, 0], [4, 8])
    np.testing.assert_allclose(n.inverse(n.forward([3, 5])), [3, 5])
    lo, hi = precision.merge_bounds(([0, -np.inf], [np.inf, 3]), ([-1, -2], [5, 4]))
    assert lo.tolist() == [0, -2] and hi.tolist() == [5, 3]
    fit, how = stability.fit_with_fallback(frame_of(spark, noisy()), "exponential_decay", "t", "z", p0=[1, 1, 0])
    assert how == "plain" and fit.outcome.success
    assert stability.check_problem(frame_of(spark, 1e8 * X), ["t"], "z")
    assert stability.condition(frame_of(spark, X), ["t"]) > 1


def test_callbacks(spark):
    df = frame_of(spark, noisy())
    log = io.StringIO()
    f = curve_fit(df, "exponential_decay", "t", "z", p0=[5, 5, 1], callback=callbacks.Chain(callbacks.IterationLog(log), callbacks.EarlyStopping(1, 1e9)))
    assert f.outcome.status == 5 and log.getvalue().startswith("0\t")


def test_trust_step_stays_inside():
    r = np.random.default_rng(0)
    for _ in range(50):
        m = r.normal(size=(6, 4))
        a, g, radius = m.T @ m, r.normal(size=4), r.uniform(0.01, 5)
        s = solve.trust_step(a, g, radius)
        assert np.linalg.norm(s) <= radius * (1 + 1e-5)
        best = min((g @ v + v @ a @ v / 2 for v in (radius * u / np.linalg.norm(u) * r.uniform() for u in r.normal(size=(300, 4)))), default=0)
        assert g @ s + s @ a @ s / 2 <= best + 1e-9


def test_singular_covariance_is_infinite(spark):
    f = curve_fit(frame_of(spark, 2 * X), formula("a*x + b*x", ("a", "b")), "t", "z", p0=[1, 1])
    assert np.isinf(covariance(f.outcome.state)[0]).all()


def test_planner():
    assert plan(100, 3) == "local" and plan(10**7, 3) == "aggregate" and plan(10**6, 3, 1000) == "grouped"
    assert plan(40_000, 300) == "aggregate" and plan(40_000, 300, memory=1 << 30) == "local" and plan(40_000, 3, variables=500) == "aggregate"
    assert plan(10**6, 5000) == "wide" and plan(10**6, 3, least_chunk_success=True) == "chunked" and plan(10**6, 900, 20) == "aggregate"


def test_health_of_json(spark):
    from fitloom.sources.writers import document

    f = curve_fit(frame_of(spark, 2 * X), formula("a*x + b*x", ("a", "b")), "t", "z", p0=[1, 1])
    assert json.loads(json.dumps(document(f)))["pcov"][0][0] is None
