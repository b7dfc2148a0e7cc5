"""Fits on streams that are stopped, fail and are started again, and windows with late rows."""

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from fitloom.operators.fit import curve_fit
from fitloom.streaming import incremental

SCHEMA = "k string, x double, y double"


def rows(seed, n=200, f=lambda x, k: 3 * x + k):
    r = np.random.default_rng(seed)
    out = [(None if i % 4 == 3 else f"k{i % 4}", float(x)) for i, x in enumerate(r.uniform(0, 5, n))]
    return [(k, x, float(f(x, i % 4) + 0.1 * r.normal())) for i, (k, x) in enumerate(out)] + [("k0", float("nan"), 1.0), ("k1", 1.0, None)]


def feed(spark, folder, seed, **more):
    spark.createDataFrame(rows(seed, **more), SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, fits, folder, sink, checkpoint, mode="update", fail_at=None):
    def keep(batch, i):
        batch.withColumn("batch", F.lit(i)).write.mode("append").parquet(sink)
        if i == fail_at:
            raise RuntimeError("lost")

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = fits(stream).writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def latest(spark, sink):
    """The last row of every key."""
    out = {}
    for r in sorted(spark.read.parquet(sink).collect(), key=lambda r: r.batch):
        out[r.k] = r
    return out


def test_sums_outlive_a_failed_and_a_restarted_query(spark, tmp_path):
    folder, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    fits = lambda s: incremental.stream_fits(s, "linear", "x", "y", ["k"])
    feed(spark, folder, 0)
    feed(spark, folder, 1)
    with pytest.raises(StreamingQueryException):  # after the batch is written, before it counts as done
        run(spark, fits, folder, sink, checkpoint, fail_at=1)
    feed(spark, folder, 2)
    run(spark, fits, folder, sink, checkpoint)
    whole = spark.read.parquet(folder)
    want = {r.k: r for r in fits(whole).collect()}
    got = latest(spark, sink)
    assert set(got) == {"k0", "k1", "k2", None} == set(want)
    for k, r in got.items():
        own = curve_fit(whole.filter(F.col("k").eqNullSafe(k)), "linear", "x", "y", nan_policy="omit")
        assert r.n == want[k].n == own.outcome.state.n and r.success
        np.testing.assert_allclose(r.params, own.popt, rtol=1e-9)
        np.testing.assert_allclose(r.ssr, own.outcome.state.ssr, rtol=1e-8)


def test_recursive_fits_go_on_after_a_restart(spark, tmp_path):
    folder, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    f = lambda x, k: (k + 2) * np.exp(-0.4 * x)
    fits = lambda s: incremental.stream_fits(s, "a*exp(-b*x)", "x", "y", ["k"], p0=[2.0, 0.5])
    feed(spark, folder, 3, f=f)
    feed(spark, folder, 4, f=f)
    with pytest.raises(StreamingQueryException):
        run(spark, fits, folder, sink, checkpoint, fail_at=1)
    feed(spark, folder, 5, f=f)
    run(spark, fits, folder, sink, checkpoint)
    whole = spark.read.parquet(folder)
    for k, r in latest(spark, sink).items():
        own = curve_fit(whole.filter(F.col("k").eqNullSafe(k)), "a*exp(-b*x)", "x", "y", p0=[2.0, 0.5], nan_policy="omit")
        assert r.n == own.outcome.state.n and r.success
        np.testing.assert_allclose(r.params, own.popt, rtol=2e-2)


def test_incremental_sums_are_restored(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "check")
    for seed in (6, 7):
        feed(spark, folder, seed)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        inc = incremental.Incremental("linear", "x", "y")  # a new driver knows nothing
        inc.start(stream, checkpoint).awaitTermination()
    want = curve_fit(spark.read.parquet(folder), "linear", "x", "y", nan_policy="omit")
    assert inc.n == want.outcome.state.n
    np.testing.assert_allclose(inc.solve(), want.popt, rtol=1e-9)
    empty = incremental.Incremental("linear", "x", "y")
    empty.folder = str(tmp_path / "none")
    empty.load(spark)
    assert empty.n == 0 and empty.seen == -1
