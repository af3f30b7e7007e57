"""Every registered query of the sequence operators runs; those with SQL give DuckDB's rows."""

import duckdb
import pytest

from strandlake.plans import registry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canonical(df):
    def one(v):
        if v is None or v != v:
            return "~"
        return repr(round(v, 6)) if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return sorted("|".join(map(one, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
