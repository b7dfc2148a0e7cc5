"""Guards, recovery, exact quantiles and ranks, starting rules and the command line."""

import json
import math

import numpy as np
import pytest

from fitloom import __main__ as command
from fitloom.functions.models import MODELS
from fitloom.operators import callbacks, chunked, diagnose, frame, guard, normal, precision, solve
from fitloom.operators.fit import curve_fit
from fitloom.streaming.incremental import Incremental, windowed_linear


def state(a, g):
    return normal.State(np.zeros(len(g)), 1.0, np.array(g, float), np.array(a, float), 10, 0, 1.0)


def test_decompositions_fall_back():
    r = np.random.default_rng(0)
    m = r.normal(size=(8, 3))
    a, b = m.T @ m, r.normal(size=3)
    x, plain = guard.cholesky_or_eigen(a, b)
    assert plain and np.allclose(a @ x, b)
    flat = np.array([[1.0, 1.0], [1.0, 1.0]])
    x, plain = guard.cholesky_or_eigen(flat, np.array([2.0, 2.0]))
    assert np.allclose(flat @ x, [2, 2], atol=1e-6)
    u, s, v, how = guard.robust_svd(m)
    assert how == "plain" and np.allclose(u * s @ v, m)
    bad = m.copy()
    bad[0, 0] = np.nan
    u, s, v, how = guard.robust_svd(bad)
    assert how != "plain" and np.isfinite(s).all()
    x, steps = guard.conjugate_gradients(lambda v: a @ v, b, np.diag(a))
    assert np.allclose(a @ x, b) and steps <= 4
    s, issues = guard.guarded_state(state([[1, np.nan, 0], [np.nan, 2, 0], [0, 0, 0]], [1, 2, np.inf]))
    assert issues["not_finite"] and issues["ridge"] and issues["no_influence"] == [2]
    assert np.isfinite(s.a).all() and np.isfinite(s.g).all() and np.linalg.eigvalsh(s.a)[0] > 0
    step = guard.gauss_newton_step(state([[2, 0], [0, 0]], [4, 1]))
    assert np.allclose(step, [-2, 0])


def test_limits_and_messages(spark):
    assert guard.limits(2, 3)["errors"] and not guard.limits(10, 3, ([0, 0, 0], [1, 1, 1]))["errors"]
    assert guard.limits(10, 1, ([1], [0]))["errors"] and guard.limits(10, 1, ([0], [1e120]))["warnings"] and guard.limits(11, 1, most_rows=10)["errors"]
    df = spark.createDataFrame([(float(i), 3 * math.exp(-0.5 * i)) for i in range(20)], "x double, y double")
    good = curve_fit(df, "a*exp(-b*x)", "x", "y", p0=[2.0, 0.4])
    assert guard.quality(good)["grade"] in ("excellent", "good")
    cut = curve_fit(df, "a*exp(-b*x)", "x", "y", p0=[2.0, 0.1], max_nfev=2)
    assert guard.quality(cut)["grade"] == "poor" and any("limit" in r for r in guard.explain(cut, max_nfev=2)["reasons"])
    with pytest.raises(ValueError) as e:
        curve_fit(df.selectExpr("x", "CASE WHEN x < 2 THEN NULL ELSE y END AS y"), "linear", "x", "y")
    assert "omit" in guard.failed_message(e.value)["advice"][0]
    popt, pcov, info, message, status = curve_fit(df, "a*exp(-b*x)", "x", "y", p0=[2.0, 0.4], full_output=True)
    assert np.allclose(popt, [3, 0.5]) and info["nfev"] > 1 and status > 0 and info["fvec"].count() == 20 and message
    *_, points, seconds = curve_fit(df, "a*exp(-b*x)", "x", "y", p0=[2.0, 0.4], return_eval=True, timeit=True)
    assert seconds > 0 and max(abs(r.residual) for r in points.collect()) < 1e-6


def test_rescaling_and_recovery(spark):
    df = spark.createDataFrame([(1e7 * i, None if i == 3 else 2.0 * i, "k") for i in range(11)], "x double, y double, tag string")
    out, p0, info = guard.rescaled(df, "x", "y", [1.0, 1e9])
    rows = out.collect()
    assert info["x_scale"] == 1e8 and len(info["applied"]) == 3 and max(p0) / min(p0) <= 1e6 * 1.001
    assert out.columns == ["tag", "x", "y"] and sorted(r.x for r in rows)[-1] == 1.0 and all(r.y is not None for r in rows)
    decay = spark.createDataFrame([(float(i), 5 * math.exp(-0.3 * i) + 1) for i in range(30)], "x double, y double")
    found, how = guard.recover(decay, "a*exp(-b*x) + c", "x", "y", [1.0, -800.0, 0.0], ([0, 0, -5], [50, 3, 5]))
    assert np.allclose(found.popt, [5, 0.3, 1], atol=1e-5) and how


def test_exact_quantiles_and_ranks(spark):
    r = np.random.default_rng(1)
    v = np.concatenate([r.normal(size=4000), np.full(3000, 0.25), r.exponential(100, 2000), [np.nan, np.inf]])
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(5)
    from pyspark.sql import functions as F

    shares, finite = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0], v[np.isfinite(v)]
    assert np.allclose(frame.quantiles(df, F.col("v"), shares, 50), np.quantile(finite, shares), rtol=0, atol=1e-12)
    assert frame.quantiles(df.limit(0), F.col("v"), [0.5]) == [None]
    ranks = frame.ranked_rows(df.filter("NOT isnan(v)"), [F.col("v")]).orderBy("_rank").collect()
    assert [x._rank for x in ranks] == list(range(len(ranks))) and [x.v for x in ranks] == sorted(v[~np.isnan(v)])
    got = guard.even_sample(spark.range(1000), "id", 11)
    assert sorted(x.id for x in got.collect()) == np.linspace(0, 999, 11).astype(int).tolist()
    series = spark.createDataFrame([(float(i), float((-1) ** i)) for i in range(3000)], "x double, y double")
    one, many = precision.analyse(series.coalesce(1), "x", "y"), precision.analyse(series.repartition(7), "x", "y")
    assert one == many and one["uniform"] and one["snr"] == 1.0


def test_starting_rule_of_oscillations(spark):
    t = np.linspace(1, 12, 600)
    y = 3 * np.exp(-0.2 * t) * np.cos(4 * t + 0.5) + 0.4
    for n in (1, 10):  # a short series, and one that is averaged first
        tt, yy = np.repeat(t, n), np.repeat(y, n)
        df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(tt, yy)], "x double, y double")
        fit = curve_fit(df, "damped_oscillator", "x", "y")
        assert fit.outcome.state.cost < 1e-8 and abs(abs(fit.params["w"]) - 4) < 1e-4 and abs(fit.params["g"] - 0.2) < 1e-4
    assert MODELS["damped_oscillator"].start is not None


def test_histories(spark):
    assert callbacks.stopped_at([5, 4, 4, 4, 4], 3, 0.0) == 4 and callbacks.stopped_at([5, math.nan, 4, math.inf, 3], 2, 0.0) is None
    rows = [("a", i, float(c)) for i, c in enumerate([9, 5, 5.5, float("nan"), 5.2, 5.1, 1])] + [("b", i, float(9 - i)) for i in range(7)]
    got = {r.k: r.stop for r in diagnose.early_stops(spark.createDataFrame(rows, "k string, iteration int, cost double"), 3, 0.0, ["k"]).collect()}
    assert got == {"a": 5, "b": None}
    t = callbacks.Telemetry()
    for i, c in enumerate((3.0, 2.0, 2.5)):
        t(i, c, None, {"g_norm": 1.0})
    t.record("restart", why="stuck")
    assert t.summary() == {"counts": {"iteration": 3, "restart": 1}, "first": 3.0, "last": 2.5, "falling": 0.5}


def test_solvers_advance_together():
    calls = []

    def answer(asked):
        calls.append(len(asked))
        return {k: normal.State(x, float(((x - k) ** 2).sum()), 2 * (x - k), 2 * np.eye(2), 9, 0, 1.0) if k != 7 else normal.State(x, math.nan, x, np.eye(2), 9, 1, 1.0) for k, x in asked.items()}

    out = solve.lockstep(answer, {k: solve.iterate(np.zeros(2)) for k in (1, 2, 7)})
    assert isinstance(out[7], ValueError) and all(np.allclose(out[k].theta, k) for k in (1, 2)) and calls[0] == 3 and calls[1] == 2


def test_chunks_and_shuffles(spark):
    df = spark.range(1000).selectExpr("id", "double(id % 50) AS x", "3.0 * (id % 50) + 2 AS y")
    from pyspark.sql import functions as F

    assert chunked.chunk_count(df, 300) == 4
    deal = lambda seed: {r.id: r.c for r in df.select("id", chunked.shuffled_chunk(F.col("id"), 4, seed).alias("c")).collect()}
    assert deal(1) == deal(1) != deal(2) and set(deal(1).values()) == {0, 1, 2, 3}
    theta, cov = chunked.merge(chunked.chunk_fits(df.withColumn("y", F.col("y") + F.rand(1)), "linear", "x", "y", chunked.shuffled_chunk(F.col("id"), 4), [1.0, 1.0]))
    assert abs(theta[0] - 3) < 0.01


def test_incremental_covariance_and_late_rows(spark):
    df = spark.range(500).selectExpr("double(id % 20) AS x", "2.0 * (id % 20) + rand(3) AS y", "id")
    inc = Incremental("linear", "x", "y")
    for i in range(4):
        inc.update(df.filter(f"id % 4 = {i}"), i)
    _, whole = curve_fit(df, "linear", "x", "y")
    assert np.allclose(inc.covariance(), whole, rtol=1e-6)
    events = df.selectExpr("x", "y", "timestamp_seconds(id * 60) AS ts")
    assert windowed_linear(events, "ts", "x", "y", "1 hour", late="10 minutes").count() == 9


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "d.csv").write_text("t,v\n" + "".join(f"{i},{3 * i + 1}\n" for i in range(20)))
    job = tmp_path / "job.yaml"
    job.write_text(f"data: {{input_file: '{tmp_path}/d.csv', format: csv, columns: {{x: t, y: v}}}}\nmodel: {{name: linear}}\n")
    assert command.main(["fit", str(job), "-o", str(tmp_path / "out"), "--stdout"]) == 0
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert abs(said["params"]["a"] - 3) < 1e-9 and (tmp_path / "out").is_dir()
    assert command.main(["batch", str(job), str(job), "--p0", "1", "1", "-s", str(tmp_path / "s.json")]) == 0
    assert json.loads((tmp_path / "s.json").read_text())["succeeded"] in (1, 2)
    assert command.main(["info"]) == 0 and "gaussian" in capsys.readouterr().out
    job.write_text("data: {input_file: /nowhere.csv, format: csv}\nmodel: {name: linear}\nvalidation: {min_points: 5}\n")
    with pytest.raises(Exception):
        command.main(["fit", str(job)])
