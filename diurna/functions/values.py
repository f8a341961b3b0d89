"""Values: labels, missing values and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds

T = Thresholds()


def screen_label(value: Column) -> Column:
    """screen_off is locked, screen_on is unlocked, all else in lower case; case does not matter."""
    low = F.lower(value)
    return F.when(low == "screen_off", "locked").when(low == "screen_on", "unlocked").otherwise(low)


def on_off(value: Column) -> Column:
    """on or off for the exact labels of either platform, else unknown."""
    return F.when(value.isin("UNLOCKED", "screen_on"), "on").when(value.isin("LOCKED", "screen_off"), "off").otherwise("unknown")


def terminations(events: DataFrame, label: str | None = None) -> DataFrame:
    """Events whose text speaks of termination, with that text in lower case or another label."""
    kept = events.where(F.lower("value0").contains("terminating"))
    return kept.withColumn("value0", F.lit(label) if label else F.lower("value0"))


def plausible_axes(points: DataFrame, limit: float = T.axis_limit_g) -> DataFrame:
    """Points whose three axes are known and within the limit."""
    return points.where(reduce(lambda a, b: a & b, (F.col(c).between(-limit, limit) for c in ("acc_x", "acc_y", "acc_z"))))


def to_g(points: DataFrame, gravity: float = T.gravity) -> DataFrame:
    """Axes from metres per square second to g."""
    return points.withColumns({c: F.col(c) / gravity for c in ("acc_x", "acc_y", "acc_z")})


def zero_if_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna(0, subset=columns)


def zero_if_observed(df: DataFrame, parts: list[str], total: str) -> DataFrame:
    """A missing part is 0 where the total is known."""
    return df.withColumns({c: F.when(F.col(c).isNull() & F.col(total).isNotNull(), F.lit(0).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in parts})


#: Column and the limit above which its value is impossible, by domain and platform. Fixed values.
CAPS = {
    ("gps", "android"): {"total_haversine_meters": T.max_distance_m},
    ("gps", "ios"): {"total_haversine_meters": T.max_distance_m},
    ("screen", "android"): {"afternoon_screen_time_in_seconds": T.slot_s},
    ("screen", "ios"): {"nighttime_screen_time_in_seconds": T.slot_s},
    ("activity", "android"): {
        "vigorous_pa_seconds": T.day_s, "total_active_seconds": T.day_s, "percentage_vigorous_active_daily": T.max_percentage,
        "morning_pa_seconds": T.slot_s, "afternoon_pa_seconds": T.slot_s, "evening_pa_seconds": T.slot_s, "nighttime_pa_seconds": T.slot_s,
    },
    ("activity", "ios"): {
        "non_vigorous_pa_seconds": T.day_s, "total_active_seconds": T.day_s,
        "morning_pa_seconds": T.slot_s, "afternoon_pa_seconds": T.slot_s, "evening_pa_seconds": T.slot_s,
    },
}


def capped(df: DataFrame, caps: dict[str, float]) -> DataFrame:
    """Values above their limit become null; rows stay."""
    return df.withColumns({c: F.when(F.col(c) <= F.lit(cap), F.col(c)) for c, cap in caps.items() if c in df.columns})


def complete(df: DataFrame, but: list[str]) -> DataFrame:
    """Rows with no missing value outside `but`. Plain tests on columns let the optimiser narrow outer joins below."""
    tests = [F.col(f"`{c}`").isNotNull() for c in df.columns if c not in but]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def missing_counts(df: DataFrame) -> DataFrame:
    """One row: the number of missing values of each column."""
    return df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns))


def without_sparse_columns(df: DataFrame, share: float = 0.2) -> DataFrame:
    """Drops columns with more than this share of missing values."""
    row = df.agg(*(F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in df.columns)).first()
    return df.drop(*(c for c in df.columns if (row[c] or 0) > share))


def missing_share(df: DataFrame) -> Column:
    """Share of missing values of a row."""
    return reduce(lambda a, b: a + b, (F.col(f"`{c}`").isNull().cast("int") for c in df.columns)) / F.lit(len(df.columns))


#: Score names and the bounds of normal, borderline and abnormal. Fixed values of the questionnaire.
CUTOFFS = {
    "emo_symptoms": ((0, 3), (4, 5), (6, 10)),
    "hyperactivity": ((0, 5), (6, 7), (8, 10)),
    "conduct_probs": ((0, 2), (3, 3), (4, 10)),
    "peer_probs": ((0, 2), (3, 3), (4, 10)),
    "prosocial": ((7, 10), (6, 6), (0, 5)),
}


def category(score: str, value: Column) -> Column:
    """normal, borderline or abnormal; null outside the bounds or between them."""
    normal, borderline, abnormal = CUTOFFS[score]
    return F.when(value.between(*normal), "normal").when(value.between(*borderline), "borderline").when(value.between(*abnormal), "abnormal")
