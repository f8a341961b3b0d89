"""Daily features of screen use and calls, and the checks that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.times import BUCKETS, add_seconds, bucket_seconds, sensing_date, weekday

T = Thresholds()
NAMES = [name for name, _, _ in BUCKETS]


def split_sessions(sessions: DataFrame, limit: int = T.max_daily_session_s) -> DataFrame:
    """Sessions of at most `limit` seconds with their seconds in each part of the day on which they start."""
    start = F.to_timestamp("event_start_time_local", "yyyy-MM-dd'T'HH:mm:ss")
    out = sessions.where(F.col("screen_on_time_in_secs") <= limit).withColumn("event_start", start)
    out = out.withColumns({"event_end": add_seconds(F.col("event_start"), F.col("screen_on_time_in_secs")), "date_local": sensing_date(F.col("event_start"))})
    out = out.withColumn("weekday_local", weekday(F.col("date_local")))
    return out.withColumns({f"{n}_seconds": bucket_seconds(F.col("event_start"), F.col("event_end"), F.col("date_local"), n) for n in NAMES})


def daily_screen(sessions: DataFrame) -> DataFrame:
    """One row for each participant and day. What a session has after 6AM of the next day is not counted."""
    parts = split_sessions(sessions)
    total = sum((F.col(f"{n}_seconds") for n in NAMES[1:]), F.col(f"{NAMES[0]}_seconds"))
    by_part = [a for n in NAMES for a in (F.sum(f"{n}_seconds").cast("int").alias(f"{n}_screen_time_in_seconds"), F.count_if(F.col(f"{n}_seconds") > 0).cast("int").alias(f"num_of_events_{n}"))]
    return parts.groupBy("participantid", "date_local", "weekday_local").agg(F.sum(total).cast("int").alias("total_screen_time_in_seconds"), F.count("*").cast("int").alias("num_of_events_total"), *by_part)


def _call_features(calls: DataFrame, seconds: str) -> DataFrame:
    kind = F.col("call_type")
    of = lambda name: F.sum(F.when(kind == name, F.col(seconds)))
    count = lambda name: F.count_if(kind == name).cast("int")
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    out = calls.groupBy("participantid", "date_local").agg(
        F.count("*").cast("int").alias("num_all_calls"),
        whole(F.sum(seconds)).alias("duration_all_calls_seconds"),
        count("outgoing_call_answered").alias("num_calls_made"),
        whole(of("outgoing_call_answered")).alias("duration_calls_made_seconds"),
        count("incoming_call_answered").alias("num_calls_received"),
        whole(of("incoming_call_answered")).alias("duration_calls_received_seconds"),
        count("incoming_call_unanswered").alias("num_missed_calls"),
        count("outgoing_call_unanswered").alias("num_rejected_calls"),
    )
    return out.withColumn("weekday_local", weekday(F.col("date_local")))


def daily_calls_ios(calls: DataFrame) -> DataFrame:
    local = F.to_timestamp("event_start_time_local", "yyyy-MM-dd'T'HH:mm:ss")
    return _call_features(calls.withColumn("date_local", sensing_date(local)), "call_duration_in_secs")


def raw_android_calls(raw: DataFrame) -> DataFrame:
    """Text rows with a date and a whole number of seconds up to the limit; missed and rejected calls last 0."""
    seconds = F.col("value1").try_cast("int")
    usable = raw.where(F.col("value0").rlike(r"^\d{4}-\d{2}-\d{2}") & F.col("value1").rlike(r"^[0-9]+$") & seconds.between(0, T.max_call_s))
    kind = F.col("value2")
    label = F.when(kind == "outgoing", "outgoing_call_answered").when(kind == "incoming", "incoming_call_answered").when(kind == "missed", "incoming_call_unanswered").when(kind == "rejected", "outgoing_call_unanswered").otherwise(kind)
    return usable.select("participantid", sensing_date(F.col("value0").try_cast("timestamp")).alias("date_local"), label.alias("call_type"), F.when(kind.isin("missed", "rejected"), 0).otherwise(seconds).alias("seconds"))


def daily_calls_android(raw: DataFrame) -> DataFrame:
    return _call_features(raw_android_calls(raw), "seconds")


def basic_checks(calls: DataFrame) -> DataFrame:
    """Rows, participants, missing weekdays, negative durations."""
    return calls.agg(
        F.count("*").alias("total_rows"), F.count_distinct("participantid").alias("participants"), F.count_if(F.col("weekday_local").isNull()).alias("null_weekdays"), F.count_if(F.col("duration_all_calls_seconds") < 0).alias("negative_durations")
    )


def match_status(left: Column, right: Column) -> Column:
    return F.when(left == right, "MATCH").otherwise("MISMATCH")


def call_residuals(calls: DataFrame) -> DataFrame:
    """All calls beside those made, received, missed and rejected."""
    parts = F.col("num_calls_made") + F.col("num_calls_received") + F.col("num_missed_calls") + F.col("num_rejected_calls")
    return calls.select("participantid", "date_local", "num_all_calls", (F.col("num_all_calls") - parts).cast("long").alias("residual"), match_status(F.col("num_all_calls"), parts).alias("status"))


def screen_residuals(screen: DataFrame) -> DataFrame:
    parts = sum((F.col(f"{n}_screen_time_in_seconds") for n in NAMES[1:]), F.col(f"{NAMES[0]}_screen_time_in_seconds"))
    return screen.select("participantid", "date_local", "total_screen_time_in_seconds", parts.alias("parts"), match_status(F.col("total_screen_time_in_seconds"), parts).alias("status"))


def status_shares(checked: DataFrame) -> DataFrame:
    """Count and percentage of each status."""
    counts = checked.groupBy("status").agg(F.count("*").alias("n"))
    return counts.select("status", "n", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 2).alias("percentage"))


def newest(df: DataFrame, n: int) -> DataFrame:
    """A report of the latest rows."""
    return df.orderBy(F.col("date_local").desc(), "participantid").limit(n)
