"""Time: parsing, local wall clock, days from 6AM to 6AM, parts of a day.

A local time is held as a timestamp whose fields read as the wall clock; the session's zone is UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"
ISO_LOCAL = "yyyy-MM-dd'T'HH:mm:ss"
PLAIN = "yyyy-MM-dd HH:mm:ss"
DAY_FIRST = "dd-MM-yyyy HH:mm:ss"
#: Part of a day, first hour of the day that starts at 6AM, and the hour where it ends.
BUCKETS = (("morning", 6, 12), ("afternoon", 12, 18), ("evening", 18, 24), ("nighttime", 24, 30))


def parse_timestamp(text: Column) -> Column:
    """A text time with milliseconds, with seconds, or in any form that a cast takes; else null."""
    text = text.cast("string")
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSS")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), text.try_cast("timestamp")
    )


def any_timestamp(kind: str, value: Column) -> Column:
    """A time held as text, as unix seconds or as a timestamp, by the column's type."""
    if kind == "string":
        return parse_timestamp(value)
    return F.timestamp_seconds(value) if kind in ("bigint", "int") else value.cast("timestamp")


def text_or_fallback(local: Column, utc: Column) -> Column:
    """Local text time if it has a known form (with T or a space), else the UTC one."""

    def read(text: Column) -> Column:
        plain = F.replace(text, F.lit("T"), F.lit(" "))
        with_t = F.coalesce(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss.SSS")), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss")))
        return F.when(text.like("%T%"), with_t).when(text.like("____-__-__ __:__:__"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))

    return F.coalesce(read(local), read(utc))


def effective_zone(zone: Column) -> Column:
    """The zone, or UTC where it is unknown."""
    return F.coalesce(F.nullif(zone, F.lit("Unknown_Timezone")), F.lit("UTC"))


def local_time(utc: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(utc, effective_zone(zone))


def sensing_date(local: Column) -> Column:
    """The day, from 6AM to 6AM, that a local time belongs to."""
    return F.to_date(local - F.expr("INTERVAL 6 HOURS"))


def night_date(local: Column) -> Column:
    """The date on which the night began: evenings from 22 o'clock are their own, all else the day before."""
    return F.when(F.hour(local) >= 22, F.to_date(local)).otherwise(F.to_date(local - F.expr("INTERVAL 1 DAY")))


def weekday(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def bucket_of(local: Column) -> Column:
    """Part of the day by the hour, half-open, so that fractions of a second fall into no gap."""
    h = F.hour(local)
    return F.when(h.between(6, 11), "morning").when(h.between(12, 17), "afternoon").when(h >= 18, "evening").otherwise("nighttime")


def bucket_seconds(start: Column, end: Column, day: Column, bucket: str) -> Column:
    """Seconds of [start, end] within a part of `day`."""
    lo, hi = next((a, b) for name, a, b in BUCKETS if name == bucket)
    at = lambda h: day.cast("timestamp") + F.expr(f"INTERVAL {h} HOURS")
    return F.greatest(F.lit(0), F.unix_timestamp(F.least(end, at(hi))) - F.unix_timestamp(F.greatest(start, at(lo)))).cast("long")


def add_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def event_times(events: DataFrame, compat: bool = False) -> DataFrame:
    """Zone, UTC and local start and end as text, dates and weekdays for events (participantid, measuredat, next_measuredat, timezone_id).

    With `compat` an event ends where the participant's next event in the frame starts; the last ends
    where it starts in UTC and has no local end.
    """
    zone = effective_zone(F.col("timezone_id"))
    out = events.withColumn("effective_timezone", zone).withColumn("used_utc_fallback", F.nullif(F.col("timezone_id"), F.lit("Unknown_Timezone")).isNull())
    utc_end = F.col("next_measuredat")
    if compat:
        out = out.withColumn("next_measuredat", F.lead("measuredat").over(Window.partitionBy("participantid").orderBy("measuredat", *(["event_id"] if "event_id" in out.columns else []))))
        utc_end = F.coalesce("next_measuredat", "measuredat")
    start, end = F.from_utc_timestamp("measuredat", F.col("effective_timezone")), F.from_utc_timestamp("next_measuredat", F.col("effective_timezone"))
    return out.select(
        "*",
        F.date_format("measuredat", ISO_UTC).alias("event_start_time_utc"),
        F.date_format(utc_end, ISO_UTC).alias("event_end_time_utc"),
        F.date_format(start, ISO_LOCAL).alias("event_start_time_local"),
        F.date_format(end, ISO_LOCAL).alias("event_end_time_local"),
        F.to_date("measuredat").alias("date_utc"),
        sensing_date(start).alias("date_local"),
        weekday(F.to_date("measuredat")).alias("weekday_utc"),
        weekday(sensing_date(start)).alias("weekday_local"),
    )


def point_times(points: DataFrame, ts: str = "measuredat", form: str = PLAIN) -> DataFrame:
    """UTC and local time as text, and both dates."""
    local = local_time(F.col(ts), F.col("timezone_id"))
    return points.select(
        "*",
        F.date_format(ts, form).alias("measuredat_utc"),
        F.date_format(local, form).alias("measuredat_local"),
        F.to_date(ts).alias("date_utc"),
        sensing_date(local).alias("date_local"),
    )


def time_fields(points: DataFrame, ts: str = "measuredat") -> DataFrame:
    """As point_times, with the day first in the texts and both weekdays."""
    out = point_times(points, ts, DAY_FIRST)
    return out.select("*", weekday(F.col("date_utc")).alias("weekday_utc"), weekday(F.col("date_local")).alias("weekday_local"))
