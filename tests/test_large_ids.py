"""Queries whose ids of users don't fit into 32 bits."""

import datetime as dt
import random

import duckdb
import pytest

import __spark_entry__


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events of users on both sides of 2 ** 31."""
    rng, rows = random.Random(7), []
    for user in [*range(2**31 - 20, 2**31 + 20), *range(10**10, 10**10 + 20)]:
        for day in range(9):
            for _ in range(rng.randint(1, 9)):
                rows.append((len(rows), dt.datetime(2024, 1, 1 + day), user, "view", float(rng.randint(0, 150)), f'{{"k": {rng.randint(0, 99)}}}'))
    out = tmp_path_factory.mktemp("large")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{out}/events.parquet")
    return str(out)


def both(spark, name, folder):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    found = __spark_entry__.queries()[name](spark, folder)
    columns = ", ".join(found.columns)
    return sorted(map(tuple, found.collect())), sorted(con.execute(f"SELECT {columns} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall())


def test_prepared_fold(spark, folder):
    found, expected = both(spark, "n03_fold_preparation", folder)
    assert found == expected and len(found) > 20


def test_winsorized_scores(spark, folder):
    found, expected = both(spark, "n02_winsorized", folder)
    assert found == expected and len(found) == 60
