"""Registered queries against their SQL over small tables of values that the driver's smallest tables lack."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from lakeloom.plans import build, catalog

AT = datetime.datetime(2024, 1, 1)


@pytest.fixture
def events(spark, tmp_path):
    """events(rows of (event_id, user_id, value, seconds)): the folder of a table of them."""

    def write(rows):
        full = [(i, AT + datetime.timedelta(seconds=at), user, "view", value, '{"k": 1}') for i, user, value, at in rows]
        spark.createDataFrame(full, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "part"))
        next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "events.parquet")
        return str(tmp_path)

    return write


def check(spark, name, folder, table="events"):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = c.execute(catalog.oracle_sql()[name])
    cols = [x[0] for x in want.description]
    got = [tuple(r) for r in catalog.queries()[name](spark, folder).select(*cols).collect()]
    assert sorted(got) == sorted(want.fetchall())


def test_number_at_the_bound_is_not_greater(spark, events):
    check(spark, "fn_cond_num_if_exists", events([(i, user, 1.0, i) for i, user in enumerate([38, 39, 40, 41, 42])]))


#: Users whose first values are zero, whose averages come back to zero, of one value and of many, over slices and days.
ZEROS = [(i, user, value, at) for user, values in enumerate([[0.0, 5.0, 7.0], [0.0], [0.0, 0.0, 3.0], [4.0, -36.0, 9.0], [2.0, 0.0, 0.0]]) for i, (value, at) in enumerate(zip(values, [0, 30, 200_000]), 10 * user)]


def test_first_of_an_average_is_zero(spark, events):
    check(spark, "str_ema", events(ZEROS))


def test_first_of_a_live_average_is_zero(spark, events):
    check(spark, "str_ema_live", events(ZEROS))


def test_addresses_of_large_ids(spark, events):
    ids = [0, 7, 8, 65535, 65536, 65543, 65544, 2**20, 2**32 + 9, 2**48, 2**48 + 15, 2**62 + 65536, 2**63 - 1]
    check(spark, "fn_cond_ip6", events([(i, user, 1.0, i) for i, user in enumerate(ids)]))


def test_ranks_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(build, "TASK_ROWS", 100, raising=False)
    t = spark.range(4000).selectExpr("id l_orderkey", "int(id % 7) l_linenumber", "id * 7919 % 211 l_suppkey", "double(id * 31 % 13) l_quantity", "double(id * 17 % 29) l_extendedprice")
    t.coalesce(1).write.parquet(str(tmp_path / "part"))
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "lineitem.parquet")
    check(spark, "win_rank", str(tmp_path), "lineitem")
    by_task = catalog.queries()["win_rank"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in by_task) == 4000 and max(r["count"] for r in by_task) < 400
