import pytest
from compare import connection, rows

from vellum.plans.queries import QUERIES, SQL

EMPTY_ALLOWED = {"score_map_boxes"}


@pytest.fixture(scope="module")
def con(tiny):
    return connection(tiny)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, tiny, con, name):
    got, want = QUERIES[name](spark, tiny).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0 or name in EMPTY_ALLOWED


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
