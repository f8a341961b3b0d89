"""Events without a value or a user: the scores of participants equal their SQL."""

import datetime as dt
import random

import duckdb
import pytest

import __spark_entry__


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Some days have no known value, user 7 has none at all, and some events have no user."""
    rng, rows = random.Random(3), []
    for user in [*range(40), None]:
        for day in range(9):
            unknown = user == 7 or rng.random() < 0.2
            for _ in range(rng.randint(1, 9)):
                value = None if unknown or rng.random() < 0.1 else rng.randint(0, 600) / 4
                rows.append((len(rows), dt.datetime(2024, 1, 1 + day), user, "view", value, f'{{"k": {rng.randint(0, 99)}}}'))
    out = tmp_path_factory.mktemp("gaps")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{out}/events.parquet")
    return str(out)


def test_winsorized_scores(spark, folder):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    found = __spark_entry__.queries()["n02_winsorized"](spark, folder)
    expected = con.execute(f"SELECT {', '.join(found.columns)} FROM ({__spark_entry__.oracle_sql()['n02_winsorized']})").fetchall()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str) and len(expected) == 40
