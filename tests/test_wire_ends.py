"""Queries over made packets, on events whose packets have the same ends."""

import duckdb
import pytest

from packetlake.plans.wire_queries import ENDS, ORACLES, SQL, decode_query
from tests.oracle import compare

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Events of which each stands once more, with the same host and port."""
    folder = tmp_path_factory.mktemp("events")
    duckdb.sql(f"copy (select e.* replace (event_id + i * {ENDS} as event_id) from (select * from '{DIR}/events.parquet' where event_id < 40) e, range(3) g(i)) to '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_every_event_is_a_connection(spark, repeated, name):
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{repeated}/events.parquet'")
    assert compare(decode_query(name)(spark, repeated), c.sql(ORACLES[f"decode_{name}"])) > 0
