"""Sums of doubles don't depend on how the rows of a table are stored."""

import datetime as dt
import random

import pytest

import __spark_entry__

#: Values of a day that add up to 0.6, but in one of these orders to 0.6000000000000001.
DAYS = ((0.1, 0.2, 0.3), (0.3, 0.2, 0.1), (0.6,), (0.2, 0.4), (0.5,), (0.7,))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Folders with the same events, stored forwards and backwards."""
    rng, rows = random.Random(5), []
    for user in range(48):
        for day in range(5):
            for value in rng.choice(DAYS):
                rows.append((len(rows), dt.datetime(2024, 1, 1 + day), user, "view", value, '{"k": 1}'))
    out = []
    for name, part in (("forwards", rows), ("backwards", rows[::-1])):
        folder = tmp_path_factory.mktemp(name)
        spark.createDataFrame(part, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
        out.append(str(folder))
    return out


def results(spark, name, stored):
    return [sorted(map(tuple, __spark_entry__.queries()[name](spark, folder).collect()), key=str) for folder in stored]


def test_days_above_the_median(spark, stored):
    forwards, backwards = results(spark, "e13_secondary_statistics", stored)
    assert forwards == backwards


def test_equal_participants_share_a_rank(spark, stored):
    forwards, backwards = results(spark, "f13_average_ranks", stored)
    assert forwards == backwards


def test_prepared_fold(spark, stored):
    forwards, backwards = results(spark, "n03_fold_preparation", stored)
    assert forwards == backwards


def test_winsorized_scores(spark, stored):
    forwards, backwards = results(spark, "n02_winsorized", stored)
    assert forwards == backwards
