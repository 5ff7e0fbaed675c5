import pytest

import __spark_entry__
from packetlake.plans import all_queries
from tests.oracle import compare, connect

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def database():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_those_of_the_sql(spark, database, name):
    n = compare(QUERIES[name](spark, DIR), database.sql(ORACLES[name]))
    assert n > 0 or name in ("packet_by_id",)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, DIR).count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert QUERIES.items() <= __spark_entry__.queries().items()
