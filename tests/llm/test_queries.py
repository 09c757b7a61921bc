"""The registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from sparkway.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert df.columns == [x[0] for x in want.description]
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
