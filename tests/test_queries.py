"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from sparkway.plans import analysis_queries, audit_queries, choice_queries, feature_queries, forecast_queries, inventory_queries, map_queries, more_queries, network_queries, registry, road_queries, statistics_queries, version_queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def cells(rows, columns, names):
    at = [names.index(c) for c in columns]
    return sorted(tuple("" if r[i] is None else str(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = df.columns
    got = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    assert names == columns
    want = cells(got.fetchall(), columns, names)
    assert cells([tuple(r) for r in df.collect()], columns, df.columns) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
