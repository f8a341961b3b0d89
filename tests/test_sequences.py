"""Sessions, calls, zones and days on small frames worked out by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from diurna.functions import times
from diurna.operators import daily, intervals, sequences


def at(text):
    return datetime.strptime(text, "%Y-%m-%d %H:%M:%S")


def events(spark, rows):
    return spark.createDataFrame([(p, at(t), v) for p, t, v in rows], "participantid string, measuredat timestamp, value0 string")


def zones(spark, rows=()):
    return spark.createDataFrame([(p, z, at(a), at(b)) for p, z, a, b in rows], "participantid string, timezone_id string, start_time timestamp, end_time timestamp")


def test_pairs_need_direct_neighbours(spark):
    e = events(spark, [
        ("1", "2024-01-01 10:00:00", "screen_on"), ("1", "2024-01-01 10:01:00", "screen_on"), ("1", "2024-01-01 10:02:00", "SCREEN_OFF"),
        ("1", "2024-01-01 10:02:00", "SCREEN_OFF"), ("1", "2024-01-01 11:00:00", "screen_on"), ("1", "2024-01-01 21:00:00", "screen_off"),
        ("1", "2024-01-02 01:00:00", "screen_on"), ("1", "2024-01-02 11:00:01", "screen_off"), ("2", "2024-01-01 10:00:00", "screen_off"),
    ])
    rows = sequences.screen_sessions_android(e, zones(spark)).orderBy("measuredat").collect()
    assert [r.screen_on_time_in_secs for r in rows] == [60, 36000]
    assert rows[0].event_end_time_utc == "2024-01-01T10:02:00Z" and rows[0].used_utc_fallback


def test_compat_ends_are_the_next_starts(spark):
    e = events(spark, [("1", "2024-01-01 10:00:00", "unlocked"), ("1", "2024-01-01 10:01:00", "locked"), ("1", "2024-01-01 12:00:00", "unlocked"), ("1", "2024-01-01 12:05:00", "locked")])
    rows = sequences.screen_sessions_android(e, zones(spark), compat=True).orderBy("measuredat").collect()
    assert [(r.event_end_time_utc, r.event_end_time_local) for r in rows] == [("2024-01-01T12:00:00Z", "2024-01-01T12:00:00"), ("2024-01-01T12:00:00Z", None)]


def test_termination_breaks_a_session(spark):
    lock = events(spark, [("1", "2024-01-01 10:00:00", "UNLOCKED"), ("1", "2024-01-01 10:02:00", "LOCKED")])
    end = events(spark, [("1", "2024-01-01 10:01:00", "App Terminating now"), ("1", "2024-01-01 10:01:30", "other")])
    assert sequences.screen_sessions_ios(lock, end, zones(spark)).count() == 0
    assert sequences.screen_sessions_ios(lock, None, zones(spark)).count() == 1


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([("00:00:00", "CALL_INCOMING"), ("00:00:10", "call_connected"), ("00:01:00", "CALL_DISCONNECTED")], [("call", "incoming_call_answered", 60)]),
        ([("00:00:00", "CALL_DIALING"), ("00:00:10", "CALL_DISCONNECTED")], [("call", "outgoing_call_unanswered", 0)]),
        ([("00:00:00", "CALL_DIALING"), ("00:00:10", "CALL_DISCONNECTED"), ("00:00:20", "CALL_CONNECTED")], []),
        ([("00:00:00", "CALL_INCOMING"), ("00:00:10", "CALL_CONNECTED"), ("12:00:00", "CALL_DISCONNECTED")], [("anomaly", "incoming_call_answered", 43200)]),
        ([("00:00:00", "CALL_INCOMING"), ("00:00:10", "CALL_CONNECTED"), ("11:59:59", "CALL_DISCONNECTED")], [("call", "incoming_call_answered", 43199)]),
    ],
)
def test_call_patterns(spark, rows, expected):
    e = events(spark, [("1", f"2024-01-01 {t}", v) for t, v in rows]).withColumn("timezone_id", F.lit("UTC"))
    assert [(r.kind, r.call_type, r.call_duration_in_secs) for r in sequences.call_sequences(e).collect()] == expected


def test_boundary_belongs_to_the_later_interval(spark):
    e = events(spark, [("1", "2024-01-02 00:00:00", "x"), ("1", "2023-12-31 00:00:00", "early"), ("9", "2024-01-02 00:00:00", "nobody"), ("1", "2024-01-02 00:00:00", "x")])
    z = zones(spark, [("1", "Europe/Berlin", "2024-01-01 00:00:00", "2024-01-02 00:00:00"), ("1", "America/Halifax", "2024-01-02 00:00:00", "2100-01-01 00:00:00")])
    got = sorted((r.participantid, r.value0, r.timezone_id) for r in intervals.best_zone(e, z).collect())
    assert got == [("1", "early", None), ("1", "x", "America/Halifax"), ("1", "x", "America/Halifax"), ("9", "nobody", None)]
    near = sorted((r.value0, r.timezone_id) for r in intervals.nearest_zone(e.distinct(), z).collect())
    assert near == [("early", "Europe/Berlin"), ("nobody", None), ("x", "Europe/Berlin")]


def test_zone_segments(spark):
    rows = [("1", "2024-01-01 00:00:00", "A"), ("1", "2024-01-01 01:00:00", "A"), ("1", "2024-01-01 02:00:00", "Unknown_Timezone"), ("1", "2024-01-01 03:00:00", "B"), ("1", "2024-01-01 04:00:00", "A")]
    loc = events(spark, rows).withColumnRenamed("value0", "timezone_id")
    got = [(r.timezone_id, r.start_time.hour, r.end_time.year) for r in intervals.zone_segments(loc).orderBy("start_time").collect()]
    assert got == [("A", 0, 2024), ("B", 3, 2024), ("A", 4, 2100)]


def test_sensing_day_and_parts(spark):
    rows = ["05:59:59", "06:00:00", "11:59:59", "12:00:00", "17:59:59", "18:00:00", "23:59:59", "00:00:00"]
    e = events(spark, [("1", f"2024-01-02 {t}", t) for t in rows])
    got = {r.value0: (str(r.d), r.b) for r in e.select("value0", times.sensing_date(F.col("measuredat")).alias("d"), times.bucket_of(F.col("measuredat")).alias("b")).collect()}
    assert got["05:59:59"] == ("2024-01-01", "nighttime") and got["06:00:00"] == ("2024-01-02", "morning") and got["11:59:59"][1] == "morning"
    assert got["12:00:00"][1] == "afternoon" and got["18:00:00"][1] == "evening" and got["00:00:00"] == ("2024-01-01", "nighttime")


def test_sessions_are_split_and_lose_what_is_after_six(spark):
    e = events(spark, [("1", "2024-01-01 11:30:00", "unlocked"), ("1", "2024-01-01 12:30:00", "locked"), ("1", "2024-01-02 05:30:00", "unlocked"), ("1", "2024-01-02 06:30:00", "locked"), ("1", "2024-01-03 06:00:00", "unlocked"), ("1", "2024-01-03 09:00:01", "locked")])
    rows = daily.daily_screen(sequences.screen_sessions_android(e, zones(spark))).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.total_screen_time_in_seconds, r.morning_screen_time_in_seconds, r.afternoon_screen_time_in_seconds, r.nighttime_screen_time_in_seconds, r.num_of_events_total, r.weekday_local) == (5400, 1800, 1800, 1800, 2, "Monday")


def test_android_call_guards(spark):
    raw = spark.createDataFrame(
        [("1", "2024-01-01 05:00:00", "60", "outgoing"), ("1", "2024-01-01 07:00:00", "abc", "incoming"), ("1", "2024-01-01 07:00:00", "", "incoming"), ("1", "2024-01-01 07:00:00", "43201", "incoming"), ("1", "2024-01-01 07:00:00", "43200", "incoming"), ("1", "2024-01-01 07:00:00", "9", "missed"), ("1", "2024-01-01 07:00:00", "9", "rejected"), ("1", "soon", "9", "incoming"), ("1", "2024-01-01 07:00:00", "99999999999", "incoming")],
        "participantid string, value0 string, value1 string, value2 string",
    )
    rows = {str(r.date_local): r for r in daily.daily_calls_android(raw).collect()}
    assert rows["2023-12-31"].num_calls_made == 1
    r = rows["2024-01-01"]
    assert (r.num_all_calls, r.duration_all_calls_seconds, r.num_calls_received, r.num_missed_calls, r.num_rejected_calls) == (3, 43200, 1, 1, 1)
    assert daily.call_residuals(daily.daily_calls_android(raw)).where("status <> 'MATCH'").count() == 0
