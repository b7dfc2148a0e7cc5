"""Fits at many levels, per key by checked broadcasts, in waves of chunks, and by triangles."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitloom.functions.models import formula, polynomial
from fitloom.operators import chunked, grouped, normal
from fitloom.operators.fit import curve_fit


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def lines(spark):
    r = np.random.default_rng(0)
    rows = [("a" if i % 3 else None, i % 4, float(x), float((i % 4 + 1) * x + (5 if i % 3 else -5) + 0.1 * r.normal())) for i, x in enumerate(r.uniform(0, 10, 1200))]
    return spark.createDataFrame([*rows, ("b", 9, 1.0, 1.0), ("b", 9, float("nan"), 1.0)], "g string, h int, x double, y double").cache()


def test_levels_equal_separate_fits(lines):
    got = grouped.hierarchical_fit(lines, "linear", "x", "y", ["g", "h"])
    text = plan(got)
    assert text.count("Expand") == 1 and text.count("Scan ExistingRDD") == 1
    rows = {(r.g, r.h, r.level): r for r in got.collect()}
    assert len(rows) == 4 * 2 + 1 + 3 + 1 and (None, None, 1) in rows and (None, None, 3) in rows  # a null in the data and a level of its own
    assert not rows["b", 9, 0].success and rows["b", 9, 0].error == "fewer points than parameters"
    for (g, h, level), r in rows.items():
        own = lines.filter(~F.isnan("x"))
        own = own if level & 2 else own.filter(F.col("g").eqNullSafe(g))
        own = own if level & 1 else own.filter(F.col("h").eqNullSafe(h))
        assert r.n == own.count()
        if r.success:
            want = curve_fit(own, "linear", "x", "y")
            np.testing.assert_allclose(r.params, want.popt, rtol=1e-8)
            np.testing.assert_allclose(r.stderr, list(want.stderr.values()), rtol=1e-6)
    cube = grouped.hierarchical_fit(lines, "linear", "x", "y", ["g", "h"], "cube", p0=[1.0, 1.0])
    assert {r.level for r in cube.collect()} == {0, 1, 2, 3}
    sets = grouped.hierarchical_fit(lines, "linear", "x", "y", ["g", "h"], [["h"], []])
    assert {(r.level) for r in sets.collect()} == {2, 3} and sets.count() == 6
    assert grouped.hierarchical_fit(lines.limit(0), "linear", "x", "y", ["g", "h"]).filter("level < 3").count() == 0
    with pytest.raises(ValueError):
        grouped.hierarchical_fit(lines, "a*exp(-b*x)", "x", "y", ["g"])


@pytest.mark.parametrize("few", [100, 2])
def test_solutions_are_sent_to_the_rows_and_not_rows_to_them(lines, few, monkeypatch):
    monkeypatch.setattr(grouped, "FEW", few)
    got = grouped.fit_by_key(lines, "linear", "x", "y", ["g", "h"], [1.0, 1.0])
    text = plan(got)
    if few == 100:
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
        assert text.count("Exchange hashpartitioning") == 1  # of sums
    for r in got.filter("success").collect():
        want = curve_fit(lines.filter(F.col("g").eqNullSafe(r.g) & (F.col("h") == r.h) & ~F.isnan("x")), "linear", "x", "y")
        np.testing.assert_allclose(r.params, want.popt, rtol=1e-9)


@pytest.fixture(scope="module")
def decay(spark):
    r = np.random.default_rng(1)
    x = r.uniform(0, 8, 6000)
    y = 5 * np.exp(-0.7 * x) + 1 + 0.02 * r.normal(size=len(x))
    bad = [(i, float(v), float(w) if i % 16 else float("nan")) for i, (v, w) in enumerate(zip(x, y))]
    return spark.createDataFrame(bad, "i long, x double, y double").cache()


def test_waves_start_from_the_running_estimate(decay):
    model, start = "a*exp(-b*x) + c", [1.0, 3.0, 0.0]
    warm = chunked.wave_fits(decay, model, "x", "y", F.col("i") % 16, start, waves=4)
    cold = chunked.chunk_fits(decay, model, "x", "y", F.col("i") % 16, start)
    n, good, nfev, *_ = chunked.precisions(cold)
    assert sum(w["nfev"] for w in warm.waves) < 0.8 * nfev and warm.waves[0]["nfev"] > warm.waves[3]["nfev"]
    assert good == n == 15 == warm.fits.count()  # one chunk has no finite row
    np.testing.assert_allclose(warm.theta, chunked.merge(cold)[0], rtol=1e-6)
    full = curve_fit(decay, model, "x", "y", p0=warm.theta, nan_policy="omit")
    np.testing.assert_allclose(warm.theta, full.popt, rtol=1e-2)
    assert full.outcome.nfev < curve_fit(decay, model, "x", "y", p0=start, nan_policy="omit").outcome.nfev


def test_failed_chunks_are_tried_again_in_the_next_wave(decay):
    spoiled = decay.filter("i % 16 != 0").withColumn("x", F.when(F.col("i") % 16 == 1, F.lit(1.0)).otherwise(F.col("x")))  # one x cannot fix three parameters
    got = chunked.wave_fits(spoiled, "a*exp(-b*x) + c", "x", "y", F.col("i") % 16, [4.0, 0.5, 0.0], waves=3, again=2)
    assert len(got.waves) == 5 and [r.chunk_id for r in got.failed.collect()] == [1] and got.fits.count() == 14
    assert [w["chunks"] for w in got.waves[2:]] == [6, 1, 1]
    with pytest.raises(ValueError):
        chunked.wave_fits(decay.limit(0), "a*x", "x", "y", F.col("i") % 2, [1.0])


def test_triangles_hold_what_normal_equations_lose(spark):
    x = np.linspace(51, 100, 2000)
    u = (x - 75.5) / 24.5
    y = 128 * u**8 - 256 * u**6 + 160 * u**4 - 32 * u**2 + 1
    want = np.poly1d([128, 0, -256, 0, 160, 0, -32, 0, 1])(np.poly1d([1 / 24.5, -75.5 / 24.5])).coeffs
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(7)
    error = {}
    for solver in ("normal", "qr", "auto"):
        for local in (0, 10_000):
            f = curve_fit(df, polynomial(8), "x", "y", solver=solver, local_rows=local)
            error[solver, local] = float(np.abs(f.popt / want - 1).max())
    assert max(error["qr", 0], error["qr", 10_000], error["auto", 0]) < 1e-6 < error["normal", 0]
    with pytest.raises(ValueError):
        curve_fit(df, polynomial(2), "x", "y", solver="lu")


def test_triangles_in_bounds_and_covariance(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(float(v), float(3 * np.exp(-0.5 * v) + 0.01 * r.normal())) for v in np.linspace(0, 5, 300)], "x double, y double").repartition(5)
    model = formula("a*exp(-b*x)")
    for more in ({}, {"bounds": ([0, 0], [2.5, 2])}, {"loss": "soft_l1"}):
        a, b = (curve_fit(df, model, "x", "y", p0=[1.0, 1.0], solver=s, local_rows=0, **more) for s in ("normal", "qr"))
        np.testing.assert_allclose(a.popt, b.popt, rtol=1e-5)
        np.testing.assert_allclose(a.pcov, b.pcov, rtol=1e-3)
    twice = curve_fit(df, "a*x + b*x + c", "x", "y", p0=[0.0, 0.0, 0.0], solver="qr")
    assert np.isinf(twice.pcov).all() and np.isfinite(twice.popt).all()


def test_trees_of_triangles_agree_with_one(spark, monkeypatch):
    monkeypatch.setattr(normal, "FAN", 2)
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in r.normal(size=(400, 2))], "v_x double, y double").withColumn("w", F.lit(1.0)).repartition(13)
    m = formula("a*x^2 + b*x + c")
    far, near = normal.Problem(df, m, local_rows=0), normal.Problem(df, m)
    np.testing.assert_allclose(np.abs(far.triangle([0, 0, 0])), np.abs(near.triangle([0, 0, 0])), rtol=1e-9, atol=1e-9)
    far.close()
