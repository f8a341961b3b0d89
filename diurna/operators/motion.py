"""Accelerometer points and their daily features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.times import BUCKETS, bucket_of, point_times, sensing_date, text_or_fallback, weekday
from ..functions.values import plausible_axes, to_g
from .intervals import best_zone

T = Thresholds()
AXES = ("acc_x", "acc_y", "acc_z")


def norm(columns: tuple[Column, ...]) -> Column:
    total = columns[0] * columns[0]
    for c in columns[1:]:
        total = total + c * c
    return F.round(F.sqrt(total), 4)


def numeric(value: Column) -> Column:
    """Rounded to four decimals: halves go up as the number reads in decimals, not as its binary form has it."""
    return value.cast("decimal(20,12)").cast("decimal(12,4)")


def accelerometer_points(points: DataFrame, segments: DataFrame, in_ms2: bool = False) -> DataFrame:
    """Norm, distance from the point before, and activity flags of plausible points, with times."""
    points = plausible_axes(to_g(points) if in_ms2 else points)
    # dealt by participant once; the zone, copies and differences are all found within a participant
    points = best_zone(points.repartition("participantid"), segments, "_id").dropDuplicates(["participantid", "_id"])
    before = Window.partitionBy("participantid").orderBy("measuredat", "_id")
    points = points.withColumns({f"_d_{a}": F.col(a) - F.lag(a).over(before) for a in AXES})
    size, step = norm(tuple(map(F.col, AXES))), norm(tuple(F.col(f"_d_{a}") for a in AXES))
    points = points.withColumns({"euclidean_norm_g": size, "euclidean_distance_g": step}).drop(*(f"_d_{a}" for a in AXES))
    flag = lambda test: F.coalesce(test.cast("int"), F.lit(0))
    points = points.withColumns({"non_vigorous_pa": flag(F.col("euclidean_norm_g") < T.vigorous_g), "vigorous_pa": flag(F.col("euclidean_norm_g") >= T.vigorous_g)})
    return point_times(points)


def daily_accelerometer(points: DataFrame, compat: bool = False) -> DataFrame:
    """One row for each participant and day: samples by activity and part of the day, norm statistics.

    The weekday is that of the day; with `compat` the last in the alphabet of the samples' own weekdays.
    """
    points = points.where(F.col("euclidean_norm_g").between(0, T.max_norm_g))
    points = points.withColumn("ts", text_or_fallback(F.col("measuredat_local"), F.col("measuredat_utc"))).where("ts is not null")
    points = points.withColumns({"date_local": sensing_date(F.col("ts")), "bucket": bucket_of(F.col("ts")), "own_weekday": weekday(F.col("ts"))})
    both = F.col("non_vigorous_pa") + F.col("vigorous_pa")
    slots = [F.sum(F.when(F.col("bucket") == name, both).otherwise(0)).cast("int").alias(f"{name}_pa_seconds") for name, _, _ in BUCKETS]
    out = points.groupBy("participantid", "date_local").agg(
        F.max("own_weekday").alias("own_weekday"),
        F.sum("non_vigorous_pa").cast("int").alias("non_vigorous_pa_seconds"),
        F.sum("vigorous_pa").cast("int").alias("vigorous_pa_seconds"),
        F.sum(both).cast("int").alias("total_active_seconds"),
        F.round(F.sum("vigorous_pa") * 100 / F.lit(T.day_s), 2).cast("decimal(5,2)").alias("percentage_vigorous_active_daily"),
        *slots,
        numeric(F.avg("euclidean_norm_g")).alias("avg_euclidean_norm"),
        numeric(F.max("euclidean_norm_g")).alias("max_euclidean_norm"),
        numeric(F.coalesce(F.stddev_samp("euclidean_norm_g"), F.lit(0.0))).alias("activity_variability"),
    )
    named = F.col("own_weekday") if compat else weekday(F.col("date_local"))
    return out.withColumn("weekday_local", named).drop("own_weekday")
