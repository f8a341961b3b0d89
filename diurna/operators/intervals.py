"""Intervals of validity: built from runs of equal values, and joined to events.

Events are joined to a participant's intervals on the participant, with the time as a further
condition. The intervals of one participant are few, but their table grows with the participants: it
is broadcast only if Spark's own size estimate allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAR_FUTURE = "2100-01-01 00:00:00"


def zone_segments(location: DataFrame, order: list[str] = ["measuredat"]) -> DataFrame:  # noqa: B006
    """(participantid, timezone_id, start_time, end_time): runs of one zone; each ends where the next starts."""
    known = location.where(F.col("timezone_id") != "Unknown_Timezone")
    by_time = Window.partitionBy("participantid").orderBy(*order)
    before = F.lag("timezone_id").over(by_time)
    runs = known.withColumn("fresh", (before.isNull() | (before != F.col("timezone_id"))).cast("int")).withColumn("run", F.sum("fresh").over(by_time))
    starts = runs.groupBy("participantid", "run", "timezone_id").agg(F.min("measuredat").alias("start_time"))
    following = F.lead("start_time").over(Window.partitionBy("participantid").orderBy("start_time", "run"))
    return starts.select("participantid", "timezone_id", "start_time", F.coalesce(following, F.to_timestamp(F.lit(FAR_FUTURE))).alias("end_time"))


def _row_id(events: DataFrame, row_id: str | None) -> tuple[DataFrame, str]:
    """A column that tells rows apart; equal rows are numbered."""
    if row_id:
        return events, row_id
    return events.withColumn("_row", F.row_number().over(Window.partitionBy("participantid").orderBy(*events.columns))), "_row"


def best_zone(events: DataFrame, segments: DataFrame, row_id: str | None = None) -> DataFrame:
    """Adds the zone in force at each event; both ends of an interval count, and the later start wins.

    Events outside all intervals stay, without a zone.
    """
    columns = events.columns
    events, key = _row_id(events, row_id)
    zones = segments.select(F.col("participantid").alias("_pid"), "timezone_id", "start_time", "end_time")
    inside = (F.col("participantid") == F.col("_pid")) & (F.col("measuredat") >= F.col("start_time")) & (F.col("measuredat") <= F.col("end_time"))
    met = events.drop("timezone_id").join(zones, inside, "left")
    best = Window.partitionBy("participantid", key).orderBy(F.col("start_time").desc_nulls_last(), F.col("end_time").asc_nulls_last(), "timezone_id")
    return met.withColumn("_best", F.row_number().over(best)).where("_best = 1").select(*(c for c in columns if c != "timezone_id"), "timezone_id")


def nearest_zone(events: DataFrame, segments: DataFrame, row_id: str | None = None) -> DataFrame:
    """As best_zone, but the earliest interval around an event wins, and an event outside all gets the one with the nearest end.

    Only intervals around an event are joined to it. For events outside all, the last end before and
    the first start after are found in one pass over a participant's events and ends in order of time.
    """
    columns = events.columns
    events, key = _row_id(events, row_id)
    zones = segments.select(F.col("participantid").alias("_pid"), "timezone_id", "start_time", "end_time")
    inside = (F.col("participantid") == F.col("_pid")) & F.col("measuredat").between(F.col("start_time"), F.col("end_time"))
    own = [c for c in events.columns if c != "timezone_id"]
    met = events.drop("timezone_id").join(zones, inside, "left")
    met = met.groupBy(*own).agg(F.min(F.struct("start_time", "timezone_id")).alias("b")).withColumn("timezone_id", F.col("b.timezone_id"))
    found = met.where("b.start_time is not null").select(*own, "timezone_id")
    outside = met.where("b.start_time is null").select(*own)

    ends = zones.groupBy(F.col("_pid").alias("participantid"), F.col("end_time").alias("_at")).agg(F.min(F.struct("start_time", "timezone_id")).alias("_end"))
    starts = zones.groupBy(F.col("_pid").alias("participantid"), F.col("start_time").alias("_at")).agg(F.min("timezone_id").alias("_start"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    end_kind, rows = ends.schema["_end"].dataType, F.struct(*own)
    row_kind = outside.select(rows.alias("_row")).schema["_row"].dataType
    line = outside.select("participantid", F.col("measuredat").alias("_at"), rows.alias("_row"), none(end_kind, "_end"), none("string", "_start"))
    line = line.unionByName(ends.select("participantid", "_at", none(row_kind, "_row"), "_end", none("string", "_start"))).unionByName(starts.select("participantid", "_at", none(row_kind, "_row"), none(end_kind, "_end"), "_start"))
    by_time = Window.partitionBy("participantid").orderBy("_at")
    back, ahead = by_time.rowsBetween(Window.unboundedPreceding, 0), by_time.rowsBetween(0, Window.unboundedFollowing)
    last = F.last(F.when(F.col("_end").isNotNull(), F.struct("_at", "_end")), ignorenulls=True).over(back)
    first = F.first(F.when(F.col("_start").isNotNull(), F.struct("_at", "_start")), ignorenulls=True).over(ahead)
    line = line.withColumns({"_last": last, "_first": first}).where("_row is not null")
    away = lambda c: F.abs(F.unix_micros("_at") - F.unix_micros(c))
    before = F.struct(away("_last._at").alias("away"), F.col("_last._end.start_time").alias("start_time"), F.col("_last._end.timezone_id").alias("timezone_id"))
    after = F.struct(away("_first._at").alias("away"), F.col("_first._at").alias("start_time"), F.col("_first._start").alias("timezone_id"))
    nearest = F.when(F.col("_last").isNull(), after).when(F.col("_first").isNull(), before).otherwise(F.least(before, after))
    filled = line.select("_row.*", nearest["timezone_id"].alias("timezone_id"))
    return found.unionByName(filled).select(*columns) if "timezone_id" in columns else found.unionByName(filled).select(*columns, "timezone_id")
