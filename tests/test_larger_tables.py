"""Queries on tables whose counts, keys or chunks are larger than those of the test tables."""

import duckdb
import pytest

from fitloom.plans import catalogue, catalogue_more  # noqa: F401


@pytest.fixture(scope="module")
def many_events(spark, tmp_path_factory):
    """Events whose histogram starts above 1e6, so that the decay's amplitude is beyond it."""
    d = str(tmp_path_factory.mktemp("many"))
    spark.range(3_000_000).selectExpr("id AS event_id", "-20 * ln((id * 7919 % 3000000 + 0.5) / 3000000) AS value").coalesce(1).write.parquet(f"{d}/events.parquet")
    return d


def expected(name: str, d: str, table: str) -> list:
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet/*.parquet'")
    return sorted(c.execute(catalogue.ORACLE[name]).fetchall())


def same_as_sql(spark, name: str, d: str, table: str) -> None:
    assert sorted(tuple(r) for r in catalogue.QUERIES[name](spark, d).collect()) == expected(name, d, table)


def test_auto_global_beyond_a_million(spark, many_events):
    same_as_sql(spark, "auto_global_fit", many_events, "events")


def test_cma_es_beyond_a_million(spark, many_events):
    same_as_sql(spark, "cma_es_fit", many_events, "events")


def test_multi_start_beyond_a_million(spark, many_events):
    same_as_sql(spark, "multi_start_fit", many_events, "events")


def test_sigma_of_zero(spark, tmp_path):
    rows = [(1, 19.0), (2, 20.0), (3, 20.5), (4, -3.0), (5, 20.0)]
    spark.createDataFrame(rows, "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    same_as_sql(spark, "sigma_check", str(tmp_path), "events")


def test_tournament_beyond_a_million(spark, many_events):
    same_as_sql(spark, "tournament_fit", many_events, "events")


def repeating(spark, copies: int = 20):
    from pyspark.sql import functions as F

    rows = spark.range(40 * copies).select((F.col("id") % 40).cast("double").alias("x"), F.col("id"))
    return rows.withColumn("y", 5 * F.exp(-((F.col("x") - 20) ** 2) / 50) + (F.col("x") % 3) * 0.1)


def test_search_counts_repeated_rows_once(spark):
    import numpy as np

    from fitloom.operators import search

    box = ([1.0, 5.0, 2.0], [10.0, 35.0, 20.0])
    with search.prepared(repeating(spark), "gaussian", "x", "y", box, None, "raise", 0) as s:
        assert s.counted.count() == 40
        thetas = np.array([[4.0, 18.0, 5.0], [5.0, 22.0, 4.0]])
        want = search.population_costs(s.pts, s.model, thetas)
        np.testing.assert_allclose(s.costs(thetas), want[:, 0], rtol=1e-12)
        assert s.problem()(thetas[0]).n == 800


def test_cma_es_over_counted_rows(spark, monkeypatch):
    from fitloom.operators import search

    seen, costs = [], search.population_costs
    monkeypatch.setattr(search, "population_costs", lambda pts, *a, **k: seen.append(pts) or costs(pts, *a, **k))
    box = ([1.0, 5.0, 2.0], [10.0, 35.0, 20.0])
    far = search.cma_es(repeating(spark), "gaussian", "x", "y", box, preset=(3, 0), local_rows=0)
    near = search.cma_es(repeating(spark), "gaussian", "x", "y", box, preset=(3, 0))
    assert all("_m" in p.columns for p in seen) and len(seen) == 3
    assert abs(far.popt - near.popt).max() < 1e-6 and far.outcome.state.n == 800


def test_counted_rows_lie_in_few_partitions(spark, monkeypatch):
    from fitloom.operators import frame

    pts = repeating(spark).select("x", "y")
    few = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        one = frame.repeated(pts).persist()
        assert one.rdd.getNumPartitions() == 1 and one.count() == 40 and one.agg({"_m": "sum"}).first()[0] == 800
        one.unpersist()
        monkeypatch.setattr(frame, "PARTITION_ROWS", 10)
        assert 2 < frame.repeated(pts).rdd.getNumPartitions() < 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", few)


def test_large_chunks_are_not_gathered(spark):
    from pyspark.sql import functions as F

    from fitloom.operators import chunked

    rows = repeating(spark).withColumn("y", F.when(F.col("id") % 4 == 3, F.lit(float("inf"))).otherwise(F.col("y")))
    chunk, start = F.col("id") % 3, [4.0, 18.0, 4.0]
    near = chunked.chunk_fits(rows, "gaussian", "x", "y", chunk, start).orderBy("chunk_id").collect()
    some = chunked.chunk_fits(rows, "gaussian", "x", "y", chunk, start, group_rows=199).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.n, r.success) for r in near] == [(r.chunk_id, r.n, r.success) for r in some] == [(i, 200, True) for i in range(3)]
    for a, b in zip(near, some):
        assert max(abs(p - q) for p, q in zip(a.theta, b.theta)) < 1e-6


def test_wide_fits_count_repeated_rows_once(spark):
    from fitloom.operators import wide

    rows = repeating(spark).selectExpr("x", "id % 2 AS side", "3 * x + 10 * (id % 2) + x % 3 AS y")
    terms = [wide.levels("side", "level", "side"), wide.shared("slope", "b*x")]
    got = wide.wide_fit(rows, terms, "x", "y")
    assert got.problem.pts.count() == 40 and got.outcome.state.n == 800
    import numpy as np

    x, side = np.tile(np.arange(40.0), 20), np.arange(800) % 2
    want = np.linalg.lstsq(np.stack([side == 0, side == 1, x], 1).astype(float), 3 * x + 10 * side + x % 3, rcond=None)[0]
    np.testing.assert_allclose([*(v[0] for v in got.member("side").values()), got.member("slope")[None][0]], want, atol=1e-6)


def test_many_keys_meet_their_solutions_once(spark, monkeypatch):
    import numpy as np

    from fitloom.operators import grouped

    rows = spark.range(1200).selectExpr("CASE WHEN id < 900 THEN id % 150 ELSE 1000 END AS k", "double(id % 7) AS x", "double(id % 7) * 2 + id % 5 AS y").unionByName(spark.createDataFrame([(None, 1.0, 2.0)], "k long, x double, y double"))
    want = {r.k: r for r in grouped.fit_by_key(rows, "linear", "x", "y", ["k"], [0.0, 0.0]).collect()}
    monkeypatch.setattr(grouped, "FEW", 10)
    monkeypatch.setattr(grouped, "GROUP_ROWS", 100)
    plan = grouped.fit_by_key(rows, "linear", "x", "y", ["k"], [0.0, 0.0])
    assert "Generate" not in plan._jdf.queryExecution().optimizedPlan().toString()  # no copies of the solutions
    got = {r.k: r for r in plan.collect()}
    assert got.keys() == want.keys() and len(got) == 152
    assert got[None].error == "fewer points than parameters" and got[None].n == 1 and got[None].params is None
    pdf = rows.filter("k is not null").toPandas()
    for k, own in pdf.groupby("k"):
        cov = np.polyfit(own.x, own.y, 1, cov="unscaled")[1] * np.polyfit(own.x, own.y, 1, full=True)[1] / (len(own) - 2) if own.x.nunique() > 1 else None
        np.testing.assert_allclose(got[k].params, want[k].params)
        assert got[k].n == len(own) and got[k].success
        if cov is not None:
            np.testing.assert_allclose(got[k].params, np.polyfit(own.x, own.y, 1), atol=1e-8)
            np.testing.assert_allclose(got[k].stderr, np.sqrt(np.diag(cov)), rtol=1e-6, atol=1e-9)
