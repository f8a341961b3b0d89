"""Nightly rest from screen states, in windows rather than a loop over rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.times import local_time, night_date
from ..functions.values import on_off
from .intervals import best_zone

T = Thresholds()
WINDOW_MINUTES = (24 - T.night_from_hour + T.night_to_hour) * 60


def night_events(events: DataFrame, segments: DataFrame) -> DataFrame:
    """on/off events between 22 and 8 o'clock local time with the date on which the night began."""
    known = best_zone(events.select("participantid", "measuredat", "event_type").repartition("participantid").distinct(), segments)
    known = known.withColumn("local_time", local_time(F.col("measuredat"), F.col("timezone_id")))
    hour = F.hour("local_time")
    return known.where((hour >= T.night_from_hour) | (hour < T.night_to_hour)).withColumn("date_local", night_date(F.col("local_time")))


def screen_states(android: DataFrame | None, ios: DataFrame | None) -> DataFrame:
    frames = [df.select("participantid", "measuredat", on_off(F.col("value0")).alias("event_type")) for df in (android, ios) if df is not None]
    out = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    return out.repartition("participantid").distinct()


def nightly(events: DataFrame) -> DataFrame:
    """Minutes with a screen turned on, times it was turned on after off, and what is left of the night.

    Unknown states do not count as a state before. Of events at one time off comes first.
    """
    rank = F.when(F.col("event_type") == "off", 0).when(F.col("event_type") == "on", 1).otherwise(2)
    order = Window.partitionBy("participantid", "date_local").orderBy("local_time", rank, "event_type")
    before = F.last(F.when(F.col("event_type").isin("on", "off"), F.col("event_type")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    on = F.col("event_type") == "on"
    marked = events.withColumn("starts", on & (F.coalesce(before, F.lit("")) != "on"))
    minutes = F.count_distinct(F.when(on, F.date_trunc("minute", "local_time")))
    return marked.groupBy("participantid", "date_local").agg(
        minutes.cast("int").alias("total_night_screen_minutes"),
        F.count_if("starts").cast("int").alias("total_night_screen_interruptions"),
        (F.lit(WINDOW_MINUTES) - minutes).cast("int").alias("total_inactive_minutes"),
    )


def nightly_by_rows(events: DataFrame) -> DataFrame:
    """The same by a loop over each night's rows: slow, for comparison with nightly()."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rank = rows["event_type"].map({"off": 0, "on": 1}).fillna(2)
        rows = rows.assign(_rank=rank).sort_values(["local_time", "_rank", "event_type"])
        minutes, starts, state = set(), 0, None
        for at, kind in zip(rows["local_time"], rows["event_type"], strict=True):
            if kind == "on":
                minutes.add(at.floor("min"))
                starts += state != "on"
            state = kind if kind in ("on", "off") else state
        return pd.DataFrame({"participantid": rows["participantid"].iloc[:1], "date_local": rows["date_local"].iloc[:1], "total_night_screen_minutes": [len(minutes)], "total_night_screen_interruptions": [starts], "total_inactive_minutes": [WINDOW_MINUTES - len(minutes)]})

    schema = "participantid string, date_local date, total_night_screen_minutes int, total_night_screen_interruptions int, total_inactive_minutes int"
    return events.select("participantid", "date_local", "local_time", "event_type").groupBy("participantid", "date_local").applyInPandas(one, schema)
