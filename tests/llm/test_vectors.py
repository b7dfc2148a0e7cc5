import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitloom.llm import exponion, pivots, whitening

BAD = {900: None, 901: [math.nan] * 64, 902: [math.inf] + [0.5] * 63, 903: [None] + [0.5] * 63, 904: [], 905: [0.25, -0.75]}


def sample(seed=0, n=300, d=64, spread=0.3):
    """id -> vector: clusters, copies, near copies and a zero vector."""
    r = np.random.default_rng(seed)
    heads = r.normal(size=(6, d))
    out = {i: [float(np.float32(v)) for v in heads[i % 6] + spread * r.normal(size=d)] for i in range(n)}
    for i in range(40, 90):
        out[i] = out[7]
    out[91] = [float(np.float32(v + 1e-5)) for v in out[7]]
    out[100] = [0.0] * d
    return out


def frame(spark, vectors, more=()):
    data = [(i, v, i, 1.0) for i, v in vectors.items()] + list(more)
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, x long, u double").repartition(5)


def finite(v):
    return v is not None and None not in v and bool(np.isfinite(np.array(v, float)).all())


# ---- whitening ----


def test_lanczos_finds_the_leading_pairs():
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.normal(size=(120, 120)))[0]
    e = np.concatenate([[9.0] * 5, [4.0, 3.0, 2.0], np.linspace(1, 0, 112)])  # more equal values than a block of 3 holds
    a = (q * e) @ q.T
    calls = []
    got, vectors, passes = whitening.lanczos(lambda v: calls.append(v.shape) or a @ v, 120, 8, block=3)
    np.testing.assert_allclose(got, e[:8], atol=1e-12)
    np.testing.assert_allclose(a @ vectors, vectors * got, atol=1e-11)
    assert passes == len(calls) and passes * 3 <= 120
    rank = (q[:, :4] * e[:4]) @ q[:, :4].T  # breaks down after one block
    got, vectors, passes = whitening.lanczos(lambda v: rank @ v, 120, 6, block=4)
    np.testing.assert_allclose(got, [9] * 4 + [0] * 2, atol=1e-12)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(6), atol=1e-12)
    assert passes < 10
    hidden = np.diag([0.0, 0, 5, 0, 0, 7])
    assert np.allclose(whitening.lanczos(lambda v: hidden @ v, 6, 2, block=1)[0], [7, 5])


@pytest.mark.parametrize("block", [3, 8])
def test_whitening(spark, block):
    vectors = sample(2)
    df = frame(spark, vectors | BAD, [(5, vectors[6], 1, 1.0), (None, vectors[8], 1, 1.0), (7, vectors[7], 1, 1.0)])
    got = whitening.whiten(df, block=block).collect()
    rows = [(i, v) for i, v in vectors.items()] + [(5, vectors[6]), (None, vectors[8]), (7, vectors[7])]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:16], q[:, ::-1][:, :16]
    whole = [r for r in got if r.vec_id != 905]
    assert len(whole) == 16 * len(rows) and {r.n for r in whole} == {n} and {r.component for r in whole} == set(range(1, 17))
    assert len([r for r in got if r.vec_id == 905]) == 2  # its own length, fitted alone
    assert all(r.whitened is None and r.explained is None and r.deviation == 0 for r in got if r.vec_id == 905)
    want = {}
    for (i, _), own in zip(rows, x):
        deviation = sum((n * int(a) - int(b)) ** 2 for a, b in zip(own, s))
        want.setdefault(i, []).append((deviation, np.abs((own - s / n) @ q / np.sqrt(e))))
    trace = (c * c).sum() / n
    seen = {}
    for r in whole:
        assert any(r.deviation == d and abs(abs(r.whitened) - w[r.component - 1]) < 1e-6 for d, w in want[r.vec_id])
        assert abs(r.explained - e[r.component - 1] / trace) < 1e-9 and r.identity_error < 1e-8
        seen[r.vec_id, r.component] = seen.get((r.vec_id, r.component), 0) + 1
    assert seen[5, 1] == 2 and seen[None, 3] == 1 and seen[7, 16] == 2
    sign = {r.component: np.sign(r.whitened) * np.sign(((x[0] - s / n) @ q)[r.component - 1]) for r in whole if r.vec_id == 0}
    for r in whole:  # one sign for all rows
        if r.vec_id == 3:
            assert np.sign(r.whitened) == sign[r.component] * np.sign(((x[3] - s / n) @ q)[r.component - 1])


def test_whitening_of_degenerate_tables(spark):
    assert whitening.whiten(frame(spark, {})).count() == 0
    assert whitening.whiten(frame(spark, BAD)).count() == 2
    one = whitening.whiten(frame(spark, {1: [0.5] * 20, 2: [0.5] * 20})).collect()
    assert len(one) == 32 and all(r.n == 1 and r.whitened is None and r.deviation == 0 and r.identity_error is None for r in one)
    line = whitening.whiten(frame(spark, {i: [float(i), 2.0 * i, 1.0] for i in range(50)})).collect()
    lead = [r for r in line if r.component == 1]
    assert len(line) == 150 and abs(sum(r.whitened**2 for r in lead) / 50 - 1) < 1e-9 and abs(lead[0].explained - 1) < 1e-9
    assert all(r.whitened is None and r.explained == 0 for r in line if r.component > 1)


def test_deviations_are_exact_or_null():
    m = whitening.Whitening(3, np.array([0, -(2**40)]), np.array([1, 2]), np.zeros(0), np.zeros((2, 0)), 0.0, 0)
    x = np.array([[5, -(2**40)], [2**31, -(2**40) + 2**20], [2**45, 0], [2**51, 2**51]], dtype=np.int64)
    want = [sum((3 * int(a) - (3 * int(b) + int(c))) ** 2 for a, b, c in zip(row, m.base, m.rest)) for row in x]
    assert m.deviations(x).to_pylist() == [w if w < 2**63 else None for w in want]


# ---- exponion ----


def brute_clusters(rows, k, rounds, seed):
    """Lloyd's rounds, every distance computed."""
    import hashlib

    x = [[math.floor(1024 * c) for c in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"{seed}:{rows[i][0]}".encode()).hexdigest(), x[i]))
    x, c = np.array(x), np.array([x[i] for i in order[:k]])
    nearest = lambda: ((x[:, None, :] - c[None]) ** 2).sum(2)
    for _ in range(rounds):
        a = nearest().argmin(1)
        c = np.array([x[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    d = nearest()
    return d.argmin(1), d.min(1), c


@pytest.mark.parametrize("k,rounds", [(8, 10), (1, 2), (40, 6)])
def test_exponion_equals_lloyd(spark, k, rounds):
    import hashlib

    vectors = sample(3, 400)
    rows = list(vectors.items()) + [(9, vectors[11]), (None, vectors[12]), (13, vectors[13])]
    df = frame(spark, vectors | BAD, [(*r, 1, 1.0) for r in rows[len(vectors) :]])
    work = []
    got = exponion.cluster(df, clusters=k, rounds=rounds, watch=lambda _, n: work.append(n)).collect()
    a, d, c = brute_clusters(rows, k, rounds, 3)
    text = [hashlib.sha256(",".join(map(str, own)).encode()).hexdigest() for own in c.tolist()]
    want = sorted((str(i), int(j), int(v), int(d[a == j].sum()), int(d.sum()), text[j]) for (i, _), j, v in zip(rows, a, d))
    assert sorted((str(r.vec_id), *tuple(r)[1:]) for r in got) == want
    assert work[0] == k * len(rows) and (k < 40 or sum(work[1:]) < 0.6 * rounds * work[0])  # balls, not all centroids


def test_exponion_ties_empty_clusters_and_few_rows(spark):
    pad = [0.0] * 62
    vectors = {i: [float(i % 5), float(i % 3), *pad] for i in range(60)}  # a grid: many equal distances and equal starts
    got = exponion.cluster(frame(spark, vectors), clusters=12, rounds=4).collect()
    a, d, _ = brute_clusters(list(vectors.items()), 12, 4, 3)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == [(i, int(j), int(v)) for i, (j, v) in enumerate(zip(a, d))]
    assert {r.cluster for r in exponion.cluster(frame(spark, {1: [1.0] * 64, 2: [2.0] * 64})).collect()} == {0, 1}
    assert {(r.cluster, r.distance) for r in exponion.cluster(frame(spark, {i: [1.0] * 64 for i in range(30)})).collect()} == {(0, 0)}
    assert exponion.cluster(frame(spark, BAD)).count() == 0
    big = {1: [1e5] * 64, 2: [-1e5] * 64, 3: [1e7] * 64, 4: [1.0] * 64}
    got = {r.vec_id: r.distance for r in exponion.cluster(frame(spark, big), clusters=1, rounds=1).collect()}
    a, d, _ = brute_clusters([(i, big[i]) for i in (1, 2, 4)], 1, 1, 3)
    assert got == {1: d[0], 2: d[1], 4: d[2]}  # one is too long


# ---- pivots ----


def brute_top(rows, k, every):
    ok = {(i, tuple(math.floor(1024 * c) for c in v)) for i, v in rows if i is not None and v and finite(v)}
    out = {}
    for i, q in ok:
        if i % every == 0:
            for j, x in ok:
                if i != j and len(q) == len(x):
                    s = sum(a * b for a, b in zip(q, x))
                    own = out.setdefault(i, {})
                    own[j] = max(own.get(j, s), s)
    return {i: sorted(own.items(), key=lambda x: (-x[1], x[0]))[:k] for i, own in out.items()}


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("block,spread", [(16, 0.02), (64, 0.3), (8192, 0.3)])
def test_top_k_is_exact_and_stops(spark, block, spread, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", block)
    monkeypatch.setattr(pivots, "QUERY_BLOCK", 8)
    vectors = sample(4, 600, 24, spread) | {i: v for i, v in BAD.items()} | {910: [0.25] * 24, 920: [1e4] * 24, 930: [1e7] * 24, 1000: [1.0, 1.0]}
    rows = list(vectors.items()) + [(7, vectors[7]), (None, vectors[8])]
    met = []
    got = pivots.search(frame(spark, vectors, [(*r, 1, 1.0) for r in rows[len(vectors) :]]), F.col("id") % 20 == 0, pivots=6, watch=lambda _, n: met.append(n))
    want = brute_top([r for r in rows if r[0] != 930], 10, 20)
    assert answers(got) == want
    if block == 16:  # tight clusters: most annuli are never met
        assert sum(met) < 0.6 * 31 * 600 / 16


@pytest.mark.parametrize("copies", [2, 60])
def test_top_k_lists_an_id_with_several_vectors_once(spark, copies):
    r = np.random.default_rng(5)
    rows = [(i, [float(np.float32(v)) for v in r.normal(size=6)]) for i in range(40)]
    rows += [(7, [v * (2 + 0.01 * n) for v in rows[0][1]]) for n in range(copies)]  # crowds query 0
    rows += [(20, rows[3][1]), (9, rows[11][1]), (9, rows[11][1]), (5, rows[30][1]), (35, rows[30][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert answers(pivots.search(df, F.col("id") % 20 == 0, k=5)) == brute_top(rows, 5, 20)
    assert pivots.search(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert answers(pivots.search(df.filter("vec_id < 3"), F.col("id") == 0)) == brute_top([x for x in rows if x[0] < 3], 10, 20)


def test_bounds_of_annuli_hold():
    r = np.random.default_rng(6)
    x, q = np.rint(300 * r.normal(size=(400, 12))), np.rint(300 * r.normal(size=(50, 12)))
    p = pivots.placed(x, 5)
    gaps = pivots.distances(x, p)
    near, least = gaps.argmin(1), gaps.min(1)
    bins = {}
    for i in range(len(x)):
        bins.setdefault((near[i], int(least[i] // 100)), []).append(i)
    from types import SimpleNamespace as Bin

    made = [Bin(pivot=int(p_), bin=b, r0=least[i].min(), r1=least[i].max(), most=(x[i] ** 2).sum(1).max(), n=len(i)) for (p_, b), i in bins.items()]
    annuli = pivots.Annuli(made, p, 40)
    high = annuli.bounds(q)
    for b, i in bins.items():
        assert (high[:, annuli.of[b]][:, None] >= q @ x[i].T).all()
    assert annuli.n.sum() == 400 and all(n <= 40 for n, t in zip(annuli.n, annuli.tiles) if t == 1)
