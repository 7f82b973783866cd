import os

import duckdb
import pytest

from sluice.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the generated tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(frame, columns):
    return sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
    assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() and set(SQL) <= set(__spark_entry__.queries())
