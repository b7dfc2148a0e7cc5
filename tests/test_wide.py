"""Fits with many parameters: against dense least squares, numpy factors and plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitloom.operators import solve, wide
from fitloom.operators.fit import curve_fit


@pytest.fixture(scope="module")
def crossed(spark):
    r = np.random.default_rng(0)
    rows = [(int(r.integers(30)), str(r.integers(12)) if r.random() > 0.05 else None, float(r.normal()), float(r.normal()) * 0.1) for _ in range(2000)]
    level, other = r.normal(size=30), {str(i): v for i, v in enumerate(r.normal(size=12))} | {None: 0.7}
    data = [(a, b, x, float(level[a] + other[b] + 2.5 * x + e)) for a, b, x, e in rows]
    return spark.createDataFrame(data, "a int, b string, x double, y double").cache(), data


def test_crossed_levels_equal_dense_least_squares(crossed):
    df, data = crossed
    terms = [wide.levels("a", "p", "a"), wide.levels("b", "q", "b"), wide.shared("slope", "s*x")]
    got = wide.wide_fit(df, terms, "x", "y")
    assert got.problem.method == "cg" and got.problem.products > 3
    keys = sorted({b for _, b, *_ in data}, key=str)
    m = np.zeros((len(data), 30 + len(keys) + 1))
    for i, (a, b, x, _) in enumerate(data):
        m[i, a] = m[i, 30 + keys.index(b)] = 1
        m[i, -1] = x
    want = np.linalg.lstsq(m, np.array([y for *_, y in data]), rcond=None)[0]
    fitted = np.array([got.member("a")[a][0] + got.member("b")[b][0] + got.member("slope")[None][0] * x for a, b, x, _ in data])
    np.testing.assert_allclose(fitted, m @ want, atol=1e-8)  # levels of two sets share a constant, so compare what they say
    assert None in got.member("b") and got.table().count() == m.shape[1]


@pytest.mark.parametrize("method", ["cg", "blocks"])
@pytest.mark.parametrize("loss", ["linear", "soft_l1"])
def test_nonlinear_members_in_bounds_equal_separate_fits(spark, method, loss):
    r = np.random.default_rng(1)
    data = [(k, float(x), float((k + 1) * np.exp(-0.3 * (k + 1) * x) + 0.01 * r.normal())) for k in range(6) for x in np.linspace(0, 4, 60)]
    df = spark.createDataFrame(data, "k int, x double, y double")
    got = wide.wide_fit(df, [wide.levels("decay", "a*exp(-b*x)", "k")], "x", "y", p0={"decay": [2.0, 0.5]}, bounds={"decay": ([0, 0.1], [5.5, 4])}, loss=loss, method=method)
    for k in range(6):
        one = curve_fit(df.filter(F.col("k") == k), "a*exp(-b*x)", "x", "y", p0=[2.0, 0.5], bounds=([0, 0.1], [5.5, 4]), loss=loss)
        np.testing.assert_allclose(got.member("decay")[k], one.popt, rtol=2e-4)
    assert got.outcome.success and got.member("decay")[5][0] <= 5.5


def test_wide_results_have_the_standard_errors_of_dense_fits(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(float(x), float(2 * np.exp(-0.5 * x) + 1 + 0.05 * r.normal())) for x in np.linspace(0, 6, 200)], "x double, y double")
    got = wide.wide_fit(df, [wide.shared("all", "a*exp(-b*x) + c")], "x", "y", p0={"all": [1.0, 1.0, 0.0]})
    want = curve_fit(df, "a*exp(-b*x) + c", "x", "y", p0=[1.0, 1.0, 0.0])
    np.testing.assert_allclose(got.theta, want.popt, rtol=1e-6)
    np.testing.assert_allclose(got.stderr(), list(want.stderr.values()), rtol=1e-4)


def test_intervals_touch_only_their_rows(spark, capsys):
    r = np.random.default_rng(3)
    x = r.uniform(-1, 11, 3000)
    mids = np.arange(10) + 0.5
    amp = r.uniform(1, 3, 10)
    y = sum(a * np.exp(-(((x - m) / 0.5) ** 2)) * (np.abs(x - m) <= 0.9) for a, m in zip(amp, mids))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    low, high = [*(mids - 0.9), 50.0], [*(mids + 0.9), 51.0]  # the last has no rows
    term = wide.local("peak", "a*exp(-((x - (low + high)/2)/w)^2)", "x", low, high)
    got = wide.wide_fit(df, [term], "x", "y", p0={"peak": [1.5, 0.6]})
    assert got.problem.method == "blocks"
    found = np.array(list(got.member("peak").values()))
    np.testing.assert_allclose(found[:10], np.stack([amp, np.full(10, 0.5)], 1), rtol=1e-6)
    assert found[10].tolist() == [1.5, 0.6]
    i, j, _ = got.problem.cells(got.theta)
    assert len(i) < 10 * 3 + 9 * 4 + 1  # own cells and those of the next peak
    got.problem.pts.explain()
    assert "BroadcastHashJoin" in capsys.readouterr().out
    with pytest.raises(ValueError):
        wide.local("peak", "a", "x", [1.0], [0.0])


def test_factor_solves_with_fill_in():
    r = np.random.default_rng(4)
    of = np.repeat(np.arange(7), [2, 1, 3, 2, 1, 2, 2])
    m = r.normal(size=(40, len(of))) * (r.random((40, 7)) < 0.4)[:, of]
    a = m.T @ m
    i, j = np.nonzero(np.triu(a))
    f = wide.Factor(of, i, j, a[i, j], np.full(len(of), 0.5))
    b = r.normal(size=len(of))
    np.testing.assert_allclose(f.solve(b), np.linalg.solve(a + 0.5 * np.eye(len(of)), b), rtol=1e-10)


def test_cut_paths_agree_with_the_dense_step():
    r = np.random.default_rng(5)
    m = r.normal(size=(60, 20))
    a, g = m.T @ m, r.normal(size=20) * 50
    state = type("S", (), {"theta": np.zeros(20), "problem": type("P", (), {"product": lambda self, t, v: a @ v, "forcing": 1e-12})()})()
    k = wide.Krylov(state, np.ones(20), g, np.zeros(20))
    s, bent = k.step(np.inf)
    np.testing.assert_allclose(s, -np.linalg.solve(a, g), rtol=1e-8)
    np.testing.assert_allclose(bent, a @ s, rtol=1e-8)
    value = lambda x: g @ x + x @ a @ x / 2
    steps = len(k.path)
    for radius in (0.5, 0.1):
        cut, bent = k.step(radius)
        assert abs(np.linalg.norm(cut) - radius) < 1e-9 and len(k.path) == steps  # no new products
        np.testing.assert_allclose(bent, a @ cut, rtol=1e-8, atol=1e-8)
        best = solve.trust_step(a, g, radius)
        assert value(cut) <= 0.5 * value(best) < 0


def test_empty_tables_and_unknown_methods(spark):
    none = spark.createDataFrame([], "k int, x double, y double")
    with pytest.raises(ValueError):
        wide.wide_fit(none, [wide.levels("a", "p", "k")], "x", "y")
    with pytest.raises(ValueError):
        wide.wide_fit(none, [wide.levels("a", "p", "k")], "x", "y", method="qr")


def test_rows_of_equal_levels_are_folded_to_triangles(spark, monkeypatch):
    """The same fit from far fewer rows: null levels, weights, one very frequent pair, two parameters a level."""
    r = np.random.default_rng(6)
    data = [(int(a) if a < 9 else None, str(b), float(x), float(a + 0.3 * b + 2.5 * x + e), float(s)) for a, b, x, e, s in zip(r.integers(10, size=4000), r.integers(3, size=4000), r.normal(size=4000), r.normal(size=4000), r.uniform(0.5, 2, 4000))]
    data += [(3, "1", float(x), float(x * x), 1.0) for x in np.linspace(-3, 3, 12_000)]
    df = spark.createDataFrame(data, "a int, b string, x double, y double, s double")
    terms = [wide.levels("a", "p + q*x", "a"), wide.levels("b", "t", "b"), wide.shared("bend", "u*x^2 + x")]
    plain = wide.wide_fit(df, terms, "x", "y", sigma="s")
    assert plain.problem.pts.count() == len(data)
    monkeypatch.setattr(wide, "FOLDED", 100)
    got = wide.wide_fit(df, terms, "x", "y", sigma="s")
    assert got.problem.folded and got.problem.pts.count() < len(data) / 10
    assert got.outcome.state.n == len(data) and got.outcome.state.bad == 0
    np.testing.assert_allclose(got.outcome.state.cost, plain.outcome.state.cost, rtol=1e-9)
    np.testing.assert_allclose(got.outcome.state.ssr, 2 * got.outcome.state.cost)
    for key, (p, q) in plain.member("a").items():  # levels of two sets share a constant
        mine, shift = got.member("a")[key], plain.member("b")["0"][0] - got.member("b")["0"][0]
        np.testing.assert_allclose([mine[0] - shift, mine[1]], [p, q], atol=1e-6)
    assert None in got.member("a") and len(got.member("a")) == 10
    blocks = wide.wide_fit(df, [terms[0], terms[2]], "x", "y", sigma="s", method="blocks")
    assert blocks.problem.folded
    monkeypatch.setattr(wide, "FOLDED", 10**6)
    np.testing.assert_allclose(blocks.theta, wide.wide_fit(df, [terms[0], terms[2]], "x", "y", sigma="s", method="blocks").theta, atol=1e-6)


def test_folded_rows_that_are_not_finite_count_as_bad(spark, monkeypatch):
    monkeypatch.setattr(wide, "FOLDED", 10)
    df = spark.range(900).selectExpr("id % 3 AS a", "double(id) AS x", "IF(id = 7, double('nan'), double(id % 11)) AS y")
    with pytest.raises(ValueError, match="not finite"):
        wide.wide_fit(df, [wide.levels("a", "p", "a"), wide.shared("slope", "s*x")], "x", "y", nan_policy="propagate")
    got = wide.wide_fit(df, [wide.levels("a", "p", "a"), wide.shared("slope", "s*x")], "x", "y", nan_policy="omit")
    assert got.problem.folded and got.outcome.state.n == 899


def test_largest_levels_are_solved_for_apart(spark, monkeypatch):
    """No vector of the driver grows with the members, whose parameters are a table: the same fit, with a null member, a
    very frequent one, weights, members of one row and starts."""
    r = np.random.default_rng(7)
    data = [(int(a) if a < 399 else None, str(b), float(x), float(a % 7 + 0.3 * b + (2.5 + a % 3) * x + e), float(s)) for a, b, x, e, s in zip(r.integers(400, size=6000), r.integers(5, size=6000), r.normal(size=6000), r.normal(size=6000), r.uniform(0.5, 2, 6000))]
    data += [(3, str(i % 5), float(x), float(x * x), 1.0) for i, x in enumerate(np.linspace(-3, 3, 25_000))] + [(1000 + i, "1", 2.0, float(i), 1.0) for i in range(5)]
    df = spark.createDataFrame(data, "a int, b string, x double, y double, s double")
    terms = [wide.shared("bend", "u*x^2 + x"), wide.levels("a", "p + q*x", "a"), wide.levels("b", "t", "b")]
    plain = wide.wide_fit(df, terms, "x", "y", sigma="s", method="cg")
    slope = [wide.levels("a", "p", "a"), wide.shared("slope", "s*x")]
    alone, single = wide.wide_fit(df, slope, "x", "y"), wide.wide_fit(df, [slope[0]], "x", "y")
    monkeypatch.setattr(wide, "HELD", 100, raising=False)
    got = wide.wide_fit(df, terms, "x", "y", sigma="s", p0={"a": [0.5, 7.0], "bend": 0.1})
    assert got.problem.k == len(got.theta) == 6 and got.outcome.state.n == len(data) and got.outcome.state.bad == 0
    np.testing.assert_allclose(got.outcome.state.cost, plain.outcome.state.cost, rtol=1e-9)
    mine, theirs, shift = got.member("a"), plain.member("a"), plain.member("b")["0"][0] - got.member("b")["0"][0]  # levels of two sets share a constant
    assert mine.keys() == theirs.keys() and None in mine and len(mine) == 405
    for key, (p, q) in theirs.items():
        np.testing.assert_allclose(mine[key][0] - shift + 2 * mine[key][1], p + 2 * q, atol=1e-5)
        if key is None or key < 1000:
            np.testing.assert_allclose(mine[key][1], q, atol=1e-5)
    assert mine[1003][1] == 7.0  # one row: what it does not tell apart stays at its start
    np.testing.assert_allclose(got.member("bend")[None], plain.member("bend")[None], atol=1e-7)
    assert got.table().schema == plain.table().schema
    text = {(t.term, t.member, t.param): t.value for t in got.table().collect()}
    assert len(text) == plain.table().count() and text["a", "17", "q"] == mine[17][1] and text["a", None, "p"] == mine[None][0]
    with pytest.raises(ValueError):
        got.stderr()
    for want, found in ((alone, wide.wide_fit(df, slope, "x", "y")), (single, wide.wide_fit(df, [slope[0]], "x", "y"))):
        assert found.problem.apart == 1 and found.problem.k == len(found.parts) and found.outcome.success
        values = found.member("a")
        np.testing.assert_allclose([values[k] for k in want.member("a")], list(want.member("a").values()), atol=1e-6)
        np.testing.assert_allclose(found.outcome.state.cost, want.outcome.state.cost, rtol=1e-10)


def test_members_solved_apart_need_finite_rows(spark, monkeypatch):
    monkeypatch.setattr(wide, "HELD", 10, raising=False)
    df = spark.range(900).selectExpr("IF(id % 30 = 4, double('nan'), IF(id % 60 = 30, -0.0D, double(id % 30))) AS a", "double(id) AS x", "IF(id = 7, double('nan'), double(id % 11)) AS y")
    terms = [wide.levels("a", "p", "a"), wide.shared("slope", "s*x")]
    with pytest.raises(ValueError, match="not finite"):
        wide.wide_fit(df, terms, "x", "y", nan_policy="propagate")
    got = wide.wide_fit(df, terms, "x", "y", nan_policy="omit")
    assert got.problem.apart and got.outcome.state.n == 899
    assert {r.member for r in got.table().collect()} == {None, *(str(float(i)) for i in range(30) if i != 4), "nan"}


def test_batches_are_cut_between_members():
    import pyarrow as pa

    keys = [None, None, 1, 1, 1, 1, 1, 1, 1, 2, 3, 3, 4, 5, 5, 5]
    for cuts in ([1, 2, 3], [4, 4, 8, 9], [9, 10, 11, 12, 13], [5, 14]):
        parts = [pa.record_batch({"_key": pa.array(p.tolist(), pa.int64())}) for p in np.split(np.array(keys, object), cuts)]
        got = [b.column("_key").to_pylist() for b in wide.whole(iter(parts))]
        assert sum(got, []) == keys and len({k for b in got for k in set(b)}) == sum(len(set(b)) for b in got)
    assert list(wide.whole(iter([]))) == []
