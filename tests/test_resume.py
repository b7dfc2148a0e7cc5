"""Logs of evaluations, arrays by ranges, lags across blocks, autoregressive errors, grids from SQL."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitloom.functions.models import formula
from fitloom.operators import correlated, frame, search, storage
from fitloom.operators.fit import curve_fit
from fitloom.sources import arrays, readers

BOX = ([0.0, 0.0], [10.0, 3.0])


class Lost(Exception):
    pass


@pytest.fixture(scope="module")
def decay(spark):
    r = np.random.default_rng(0)
    return spark.createDataFrame([(float(x), float(4 * np.exp(-0.6 * x) + 0.05 * r.normal())) for x in np.linspace(0, 6, 240)], "x double, y double").cache()


@pytest.fixture
def counted(monkeypatch):
    """Counts evaluations of populations and points, and loses the driver after `left` of them."""
    state = {"n": 0, "left": 10**9}
    costs, points = search.block_costs, search.normal.Problem.summed

    def tick(f):
        def run(*args, **more):
            if state["left"] <= 0:
                raise Lost
            state["left"] -= 1
            state["n"] += 1
            return f(*args, **more)

        return run

    monkeypatch.setattr(search, "block_costs", tick(costs))
    monkeypatch.setattr(search.normal.Problem, "summed", tick(points))
    return state


FITS = {
    "cma_es": lambda df, log: search.cma_es(df, "a*exp(-b*x)", "x", "y", BOX, preset="fast", log=log),
    "multi_start": lambda df, log: search.multi_start(df, "a*exp(-b*x)", "x", "y", BOX, n_starts=4, log=log),
    "curve_fit": lambda df, log: curve_fit(df, "a*exp(-b*x)", "x", "y", p0=[1.0, 2.0], log=log),
    "triangles": lambda df, log: curve_fit(df, "a*exp(-b*x)", "x", "y", p0=[1.0, 2.0], solver="qr", log=log),
}


@pytest.mark.parametrize("name", sorted(FITS))
@pytest.mark.parametrize("stop", [1, 4])
def test_stopped_fits_take_the_same_path(decay, counted, tmp_path, name, stop):
    whole = FITS[name](decay, None)
    n = counted["n"]
    counted.update(n=0, left=stop)
    with pytest.raises(Lost):
        FITS[name](decay, str(tmp_path / "log"))
    counted["left"] = 10**9
    again = FITS[name](decay, str(tmp_path / "log"))
    assert n <= counted["n"] < n + 4 and again.popt.tolist() == whole.popt.tolist() and again.pcov.tolist() == whole.pcov.tolist()
    counted["left"] = 0
    assert FITS[name](decay, str(tmp_path / "log")).popt.tolist() == whole.popt.tolist()  # all from the log


def test_tournaments_go_on_and_logs_of_other_fits_are_refused(spark, decay, tmp_path, monkeypatch):
    run = lambda log: search.tournament(decay, "a*exp(-b*x)", "x", "y", BOX, n_candidates=16, rounds=3, log=log)
    want, costs, left = run(None), search.population_costs, [2]

    def some(*args, **more):
        left[0] -= 1
        if left[0] < 0:
            raise Lost
        return costs(*args, **more)

    monkeypatch.setattr(search, "population_costs", some)
    with pytest.raises(Lost):
        run(str(tmp_path / "log"))
    left[0] = 100
    got = run(str(tmp_path / "log"))
    assert left[0] == 99 and got[1] == want[1] and got[0].popt.tolist() == want[0].popt.tolist()  # one of three rounds was left
    with pytest.raises(ValueError, match="another fit"):
        curve_fit(decay, "a*exp(-b*x)", "x", "y", p0=[1.0, 2.0], log=str(tmp_path / "log"))
    (tmp_path / "log" / "00000001.json").unlink()
    with pytest.raises(ValueError, match="missing"):
        storage.Log(spark, str(tmp_path / "log"))


def test_written_tables_can_be_cleared(spark, monkeypatch):
    monkeypatch.setattr(storage, "_WRITTEN", [])
    t = storage.written(spark.range(5), "some")
    path = storage._WRITTEN[0]
    assert t.count() == 5 and storage.clear(spark) == 1 and storage.clear(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


# ---- arrays ----


def test_archives_are_read_by_ranges(spark, tmp_path):
    n = 250_000
    u, v = np.arange(n, dtype=np.float32), np.arange(n)[::-1].astype(np.int64)
    np.savez(tmp_path / "a.npz", u=u, v=v, s=np.array(["x"] * 3), short=np.arange(3))
    df = arrays.read_arrays(spark, str(tmp_path), {"x": "u", "y": "v"}, rows=60_000)
    assert df.rdd.getNumPartitions() == 5
    got = df.orderBy("ord").toPandas()
    assert (got.x == u).all() and (got.y == v).all() and (got.ord == np.arange(n)).all()
    for keys in ({"x": "s"}, {"x": "u", "y": "short"}):
        with pytest.raises(Exception, match="not numbers|different lengths"):
            arrays.read_arrays(spark, str(tmp_path), keys).count()
    other = tmp_path / "more"
    other.mkdir()
    grid = np.asfortranarray(np.arange(12.0).reshape(3, 4))
    np.savez_compressed(other / "b b.npz", u=np.arange(100_000), v=np.ones(100_000))
    np.savez(other / "c.npz", u=grid, v=grid.T.copy())
    np.savez(other / "d.npz", u=np.zeros(0), v=np.zeros(0))
    got = readers.load(spark, str(other), {"x": "u", "y": "v"}, "npz", rows=30_000)
    assert got.rdd.getNumPartitions() == 2  # neither can be entered in its middle
    rows = got.orderBy("ord").limit(24).collect()
    assert got.count() == 100_012 and got.agg(F.sum("x")).first()[0] == 99_999 * 50_000 + 66
    assert sorted(r.x for r in rows[:4]) == [0, 0, 1, 1]


def test_tables_go_out_as_archives_and_come_back(spark, tmp_path):
    df = spark.range(2500).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") % 2 == 0, F.col("id") * 0.5).alias("b")).repartition(3)
    for _ in range(2):
        arrays.write_arrays(df, str(tmp_path / "out"), rows=400, mode="overwrite")
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) == 9 and all(f.name.endswith(".npz") for f in files)
    back = arrays.read_arrays(spark, str(tmp_path / "out"), {"a": "a", "b": "b"})
    assert sorted(r.a for r in back.collect()) == list(range(2500)) and back.filter(F.isnan("b")).count() == 1250
    arrays.write_arrays(df.limit(10), str(tmp_path / "out"))
    assert arrays.read_arrays(spark, str(tmp_path / "out"), {"a": "a"}).count() == 2510


# ---- series ----


@pytest.mark.parametrize("block", [4, 100_000])
def test_lags_cross_blocks_but_not_keys(spark, block):
    r = np.random.default_rng(1)
    data = [(None if k == 2 else k, t, float(r.normal())) for k in range(3) for t in range([17, 1, 30][k])]
    df = spark.createDataFrame(data, "k int, t int, v double").repartition(5)
    got = frame.lagged(df, [F.col("t")], ["v"], 2, ("k",), block)
    own = {(k, t): v for k, t, v in data}
    rows = got.collect()
    assert len(rows) == len(data)
    for x in rows:
        assert (x.v_1, x.v_2, x["_t"]) == (own.get((x.k, x.t - 1)), own.get((x.k, x.t - 2)), min(x.t, 2))
    assert frame.lagged(df.limit(0), [F.col("t")], ["v"], 1, ("k",)).count() == 0
    ahead = frame.lagged(df, [F.col("t")], ["v"], 1, ("k",), block, leads=2).collect()
    assert len(ahead) == len(data) and all((x.v_1, x.v_next1, x.v_next2) == tuple(own.get((x.k, x.t + i)) for i in (-1, 1, 2)) for x in ahead)
    from fitloom.functions.models import turns

    wave = spark.createDataFrame([(float(t), float(np.sin(t)), t) for t in range(60)], "x double, y double, ord int").repartition(3)
    assert sorted(map(tuple, frame.turning_points(wave, 0.1, block).collect())) == sorted(map(tuple, turns(wave, 0.1).collect()))


@pytest.mark.parametrize("phi", [[0.7], [0.5, 0.3]])
@pytest.mark.parametrize("model,truth,p0", [("linear", [2.0, 1.0], None), ("a*exp(-b*x)", [3.0, 0.4], [2.0, 0.6])])
def test_series_fits_equal_dense_least_squares(spark, phi, model, truth, p0):
    r = np.random.default_rng(2)
    data, blocks = [], []
    for k, n in ((0, 60), (1, 40), (2, 1)):
        g = np.linalg.inv(correlated.start_factor(np.array(phi)))
        e = list((g @ r.normal(size=len(phi)))[:n])
        while len(e) < n:
            e.append(sum(f * e[-i] for i, f in enumerate(phi, 1)) + r.normal())
        x = r.uniform(0, 5, n)
        f = truth[0] * x + truth[1] if model == "linear" else truth[0] * np.exp(-truth[1] * x)
        y = f + 0.1 * np.array(e)
        data += [(k, t, float(a), float(b)) for t, (a, b) in enumerate(zip(x, y))]
        blocks.append(n)
    df = spark.createDataFrame([*data, (0, 500, float("nan"), 1.0)], "k int, t int, x double, y double").repartition(4)
    fit, _ = correlated.series_fit(df, model, "x", "y", ["t"], phi=phi, keys=("k",), p0=p0, block=16)
    root = np.zeros((len(data), len(data)))
    at = 0
    for n in blocks:
        own = np.eye(n)
        for i, f in enumerate(phi, 1):
            own -= f * np.eye(n, k=-i)
        p = min(n, len(phi))
        own[:p] = 0
        own[:p, :p] = correlated.start_factor(np.array(phi))[:p, :p]
        root[at : at + n, at : at + n] = own
        at += n
    cov = np.linalg.inv(root.T @ root)
    local = [(0, i, x, y, row.tolist()) for i, ((_, _, x, y), row) in enumerate(zip(data, cov))]
    want = correlated.correlated_fit(spark.createDataFrame(local, "b int, o int, x double, y double, c array<double>"), model, "x", "y", "b", "c", "o", p0=p0 or [0.0, 0.0], absolute_sigma=False)
    np.testing.assert_allclose(fit.popt, want.popt, rtol=1e-6)
    np.testing.assert_allclose(fit.pcov, want.pcov, rtol=1e-4)


def test_coefficients_are_estimated(spark):
    r = np.random.default_rng(3)
    e = [0.0]
    for _ in range(4000):
        e.append(0.6 * e[-1] + r.normal())
    df = spark.createDataFrame([(t, float(t % 50), float(2 * (t % 50) + 5 + v)) for t, v in enumerate(e)], "t int, x double, y double")
    fit, phi = correlated.series_fit(df, "linear", "x", "y", ["t"], block=500)
    assert abs(phi[0] - 0.6) < 0.05 and np.allclose(fit.popt, [2, 5], atol=0.3)
    with pytest.raises(ValueError):
        correlated.series_fit(df, "linear", "x", "y", ["t"], phi=[0.5], nan_policy="unknown", bounds=([1, 1], [0, 0]))


# ---- grids ----


def test_grid_costs_from_sql(spark, decay):
    model, thetas = formula("a*exp(-b*x)"), np.array([[4.0, 0.6], [1.0, 1.0], [2.0, 0.1]])
    search.register_grid(spark, "three_costs", model, thetas)
    decay.unionByName(spark.createDataFrame([(None, 1.0)], "x double, y double")).createOrReplaceTempView("some_points")
    got = spark.sql("SELECT candidate, sum(cost) AS c, sum(n) AS n FROM three_costs(TABLE(some_points)) GROUP BY candidate ORDER BY candidate").collect()
    x, y = (np.array([r[c] for r in decay.collect()]) for c in ("x", "y"))
    want = [0.5 * ((a * np.exp(-b * x) - y) ** 2).sum() for a, b in thetas]
    np.testing.assert_allclose([r.c for r in got], want, rtol=1e-12)
    assert {r.n for r in got} == {240} and json.dumps([r.candidate for r in got]) == "[0, 1, 2]"
