import duckdb
import pytest

import __spark_entry__
from quorumlab.plans.catalogue import ORACLES, QUERIES  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def lines(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, oracle, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = oracle.sql(ORACLES[name]).df()
    assert sorted(want.columns) == sorted(got.columns)
    assert {c: str(want[c].dtype) for c in want} == {c: str(got[c].dtype) for c in got} or not len(got)
    assert lines(want) == lines(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 106
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
