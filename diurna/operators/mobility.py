"""Daily mobility from locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.geo import step_distance, strict_coordinate
from ..functions.times import effective_zone, sensing_date

T = Thresholds()
KEYS = ["participantid", "date_utc", "date_local"]


def usable_points(location: DataFrame) -> DataFrame:
    """Points with coordinates, local time and day."""
    points = location.withColumns({"lat": strict_coordinate(F.col("location_decrypted"), 0), "lon": strict_coordinate(F.col("location_decrypted"), 1)})
    points = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"))
    local = F.from_utc_timestamp("measuredat", effective_zone(F.col("timezone_id")))
    return points.withColumns({"date_utc": F.to_date("measuredat"), "date_local": sensing_date(local)})


def steps(points: DataFrame, order: list[str] = ["measuredat", "_id"]) -> DataFrame:  # noqa: B006
    """Distance from the point before and seconds to the next, within a participant's day."""
    by_time = Window.partitionBy("participantid", "date_local").orderBy(*order)
    distance = step_distance(F.lag("lat").over(by_time), F.lag("lon").over(by_time), F.col("lat"), F.col("lon"))
    dwell = F.coalesce(F.unix_timestamp(F.lead("measuredat").over(by_time)) - F.unix_timestamp("measuredat"), F.lit(0))
    return points.withColumns({"haversine_distance": distance, "time_spent_seconds": dwell})


def dwell_entropy(seconds: Column) -> Column:
    """Shannon entropy, in nats, of the shares that dwell times have of their sum."""
    total = F.sum(seconds)
    return F.when(total > 0, F.ln(total) - F.sum(F.when(seconds > 0, seconds * F.ln(seconds)).otherwise(0)) / total).otherwise(0.0)


def daily_mobility(stepped: DataFrame) -> DataFrame:
    """One row for each participant and pair of days. Variance and radius are in degrees.

    Stays are rows of STAY seconds or more; conditional aggregates find them in the same pass, so
    nothing is joined. Without a stay their features are 0; the variance of one point is missing.
    """
    stay = F.col("time_spent_seconds") >= T.stay_s
    variance = F.when(F.count("lat") > 1, F.var_pop("lat") + F.var_pop("lon"))
    place = F.when(stay, F.struct(F.round("lat", 4), F.round("lon", 4)))
    dwell = F.when(stay, F.col("time_spent_seconds"))
    out = stepped.groupBy(*KEYS).agg(
        F.round(F.sum("haversine_distance"), 0).alias("total_haversine_meters"),
        F.count_distinct(place).cast("int").alias("number_of_stay_points"),
        F.coalesce(F.sum(dwell), F.lit(0)).cast("int").alias("total_time_at_clusters_seconds"),
        F.coalesce(dwell_entropy(dwell), F.lit(0.0)).alias("location_entropy"),
        variance.alias("location_variance"),
        F.coalesce(F.sqrt(variance), F.lit(0.0)).alias("radius_of_gyration_meters"),
    )
    return out.withColumns({c: F.round(c, 2) for c in ("location_entropy", "location_variance", "radius_of_gyration_meters")})


def daily_gps(location: DataFrame) -> DataFrame:
    return daily_mobility(steps(usable_points(location))).where("participantid is not null and date_utc is not null")
