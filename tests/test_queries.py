"""Every registered query of the reference's operators against its SQL on the smallest tables."""

import os

import pytest

from fitloom.plans import catalogue, catalogue_more  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalogue.ORACLE[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda df: df[cols].sort_values(cols).reset_index(drop=True)
    got, want = key(got), key(want)
    assert len(got) == len(want)
    for c in cols:
        same = (got[c] == want[c]) | (got[c].astype(str) == want[c].astype(str)) | (got[c].isna() & want[c].isna())
        assert same.all(), (c, got[c][~same].head().tolist(), want[c][~same].head().tolist())
