"""From daily tables of five domains to one clean table of complete days."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.values import CAPS, CUTOFFS, capped, complete, zero_if_missing, zero_if_observed
from .daily import NAMES

T = Thresholds()
KEYS = ["participantid", "date_local"]
DOMAINS = ("gps", "screen", "call", "sleep", "activity")
CALL_COLUMNS = ["num_all_calls", "duration_all_calls_seconds", "num_calls_made", "duration_calls_made_seconds", "num_calls_received", "duration_calls_received_seconds", "num_missed_calls", "num_rejected_calls"]
SCORE_COLUMNS = [f"{s}_{w}" for w in ("baseline", "followup") for s in CUTOFFS]


def on_both_platforms(android: DataFrame, ios: DataFrame) -> DataFrame:
    """Participants seen on both platforms."""
    return android.select("participantid").intersect(ios.select("participantid"))


def without(df: DataFrame, participants: DataFrame) -> DataFrame:
    return df.join(participants.select("participantid"), "participantid", "left_anti")


def device_types(participants: DataFrame, android: DataFrame, ios: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(participantid, device_type): ios if seen there, else android if seen there, else missing; overrides win."""
    seen = android.select("participantid", F.lit(0).alias("rank")).unionByName(ios.select("participantid", F.lit(1).alias("rank"))).groupBy("participantid").agg(F.max("rank").alias("rank"))
    out = participants.select("participantid").distinct().join(seen, "participantid", "left")
    out = out.select("participantid", F.when(F.col("rank") == 1, "ios").when(F.col("rank") == 0, "android").alias("device_type"))
    if overrides is None:
        return out
    fixed = overrides.select("participantid", F.col("device_type").alias("_fixed"))
    return out.join(fixed, "participantid", "left").select("participantid", F.coalesce("_fixed", "device_type").alias("device_type"))


def of_both(android: DataFrame, ios: DataFrame) -> DataFrame:
    """Rows of both platforms with the platform's name."""
    return android.withColumn("device_type", F.lit("android")).unionByName(ios.withColumn("device_type", F.lit("ios")))


def clean_calls(calls: DataFrame) -> DataFrame:
    return zero_if_missing(calls, CALL_COLUMNS)


def clean_screen(screen: DataFrame) -> DataFrame:
    screen = zero_if_observed(screen, [f"{n}_screen_time_in_seconds" for n in NAMES], "total_screen_time_in_seconds")
    return zero_if_observed(screen, [f"num_of_events_{n}" for n in NAMES], "num_of_events_total")


def clean(df: DataFrame, domain: str, platform: str) -> DataFrame:
    """Missing values and impossible values of one domain on one platform."""
    df = {"call": clean_calls, "screen": clean_screen}.get(domain, lambda x: x)(df)
    return capped(df, CAPS.get((domain, platform), {}))


def clean_platforms(df: DataFrame, domain: str) -> DataFrame:
    """As `clean`, for rows of both platforms told apart by device_type, in one pass."""
    df = clean(df, domain, "")
    caps = {p: CAPS.get((domain, p), {}) for p in ("android", "ios")}
    limit = lambda c: reduce(lambda e, p: e.when(F.col("device_type") == p, F.lit(caps[p][c])), (p for p in caps if c in caps[p]), F.when(F.lit(False), F.lit(0)))
    return df.withColumns({c: F.when(limit(c).isNull() | (F.col(c) <= limit(c)), F.col(c)) for c in df.columns if any(c in own for own in caps.values())})


def gps_by_day(gps: DataFrame) -> DataFrame:
    """One row for each day: of several UTC dates the one with the most distance, then the later."""
    best = Window.partitionBy(*KEYS).orderBy(F.col("total_haversine_meters").desc_nulls_last(), F.col("date_utc").desc_nulls_last())
    return gps.withColumn("_best", F.row_number().over(best)).where("_best = 1").drop("_best", "date_utc")


def prefixed(df: DataFrame, domain: str) -> DataFrame:
    return df.select(*KEYS, *(F.col(c).alias(f"{domain}_{c}") for c in df.columns if c not in KEYS))


def merge_days(frames: dict[str, DataFrame]) -> DataFrame:
    """All days of all domains; columns carry the domain's name."""
    return reduce(lambda a, b: a.join(b, KEYS, "full"), (prefixed(df, name) for name, df in frames.items()))


def with_scores(days: DataFrame, scores: DataFrame) -> DataFrame:
    """Adds scores by participant; case of the identifier does not matter."""
    scores = scores.withColumn("_id", F.lower("participantid")).drop("participantid")
    return days.join(scores, F.lower(days.participantid) == scores._id, "left").drop("_id")


def prepared_days(gps: DataFrame, sleep: DataFrame, android: dict[str, DataFrame], ios: dict[str, DataFrame], scores: DataFrame, overrides: DataFrame | None = None, least: int = T.min_days) -> DataFrame:
    """Complete days of all domains with platform and scores, from daily tables.

    `android` and `ios` hold the screen, call and activity tables of each platform. Participants with
    rows on both platforms are left out; location and sleep belong to the platform of their
    participant and are left out without one. Values are cleaned by domain and platform, the domains
    merged by day, and participants with fewer than `least` complete days dropped.
    """
    seen = [reduce(DataFrame.unionByName, (df.select("participantid") for df in own.values())).distinct() for own in (android, ios)]
    both = on_both_platforms(*seen)
    kinds = device_types(seen[0].unionByName(seen[1]), *seen, overrides).where("device_type is not null")
    found = {}
    for domain, df in (("gps", gps_by_day(gps)), ("sleep", sleep)):
        found[domain] = clean_platforms(without(df, both).join(kinds, "participantid"), domain)
    for domain in ("screen", "call", "activity"):
        found[domain] = clean_platforms(without(of_both(android[domain], ios[domain]), both), domain)
    days = merge_days({domain: found[domain] for domain in DOMAINS})
    days = days.withColumnRenamed("activity_device_type", "device_type").drop(*(f"{d}_{c}" for d in DOMAINS for c in ("device_type", "weekday_local")))
    return with_enough_days(complete_days(with_scores(days, scores)), least)


def complete_days(days: DataFrame) -> DataFrame:
    return complete(days, SCORE_COLUMNS)


def with_enough_days(days: DataFrame, least: int = T.min_days) -> DataFrame:
    """Rows of participants with at least this many distinct days."""
    enough = days.groupBy("participantid").agg(F.count_distinct("date_local").alias("n")).where(F.col("n") >= least)
    return days.join(enough.select("participantid"), "participantid", "left_semi")


def duplicate_days(days: DataFrame) -> DataFrame:
    """Keys that occur more than once."""
    return days.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 1")
