"""Every query with SQL gives the same rows as DuckDB; every other one runs."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tapewatch import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
    return frame.columns.tolist(), sorted(tuple(str(show(v)) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, sf, con, name):
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(registry.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, sf, name):
    frame = registry.QUERIES[name](spark, sf)
    assert len(frame.collect()) >= 0 and len(set(frame.columns)) == len(frame.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_measured_counts(spark):
    """Detector hits on the next larger tables, as counted independently."""
    sf = "/root/testdata/sf0.01"
    for name, n in (("zscore_alerts", 309), ("wash_trades", 81), ("front_running", 9), ("spoof_alerts", 54), ("ml_features", 65)):
        assert registry.QUERIES[name](spark, sf).count() == n, name
