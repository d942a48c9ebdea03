import duckdb
import pytest

from tessera.plans import catalog
from tests.compare import SF, connect, plain

import __spark_entry__  # noqa: F401, E402  registers the queries


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        assert plain(got) == plain(con.execute(catalog.ORACLES[name]).df())
    else:
        assert len(got) > 0


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_the_registered_search(spark, sf):
    got = catalog.QUERIES["vector_ann_recall"](spark, SF.replace("0.001", sf)).first()["recall"]
    assert got >= 0.95


def test_freshness_at_the_end_of_a_time_of_day(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT unnest([1, 2, 3, 4]) AS event_id, unnest([TIMESTAMP '2024-01-10 02:59:59.4', '2024-01-10 02:59:59.6', '2024-01-10 23:59:59.7', '2024-01-10 02:59:59.5']) AS ts")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = catalog.QUERIES["freshness"](spark, str(tmp_path)).toPandas()
    assert plain(got) == plain(con.execute(catalog.ORACLES["freshness"]).df())
    assert dict(zip(got["event_id"], got["tod"])) == {1: 0, 2: 1, 3: 0, 4: 1}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
