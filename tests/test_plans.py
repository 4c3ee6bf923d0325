"""Every query with SQL of its own for the check gives what that SQL gives."""

import duckdb
import pytest

from cadence.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(str(tuple(None if v is None or v != v else round(float(v), 5) if isinstance(v, float) else v for v in r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, sf, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
