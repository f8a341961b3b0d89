"""Sensor tables derived from the driver's `events` table by fixed rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Study(str):
    """A folder of tables in which `people` participants share the events of all users, so that their days are full."""

    people: int
    held: dict[str, DataFrame]

    def __new__(cls, sf_dir: str, people: int) -> Study:
        self = super().__new__(cls, sf_dir)
        self.people = people
        self.held = {}
        return self

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A small table that several branches of one query read: made once and kept on disk."""
        if name not in self.held:
            self.held[name] = make().persist(StorageLevel.DISK_ONLY)
        return self.held[name]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, participantid, measuredat, event_type, value, k)."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    if isinstance(sf_dir, Study):
        raw = raw.withColumn("user_id", F.pmod("user_id", F.lit(sf_dir.people)))
    return raw.select(
        "event_id", "user_id", F.col("user_id").cast("string").alias("participantid"), F.col("ts").cast("timestamp").alias("measuredat"), "event_type", "value",
        F.regexp_extract("props", r"(-?[0-9]+)", 1).cast("long").alias("k"),
    )


def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    return events(spark, sf_dir).select("event_id", "user_id", "participantid", "measuredat", F.when(t == "view", "unlocked").when(t == "click", "locked").otherwise(t).alias("value0"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iOS call states and, from errors, the ends of apps."""
    label = F.create_map(*(F.lit(x) for x in ("signup", "CALL_INCOMING", "view", "CALL_DIALING", "click", "CALL_CONNECTED", "purchase", "CALL_DISCONNECTED", "error", "App terminating")))
    return events(spark, sf_dir).select("event_id", "user_id", "participantid", "measuredat", label[F.col("event_type")].alias("value0"))


def calls_android(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows of calls: date-time, seconds, type; some seconds are not numbers."""
    label = F.create_map(*(F.lit(x) for x in ("signup", "outgoing", "view", "incoming", "click", "missed", "purchase", "rejected")))
    seconds = F.when(F.col("event_id") % 11 == 0, "abc").when(F.col("event_id") % 13 == 0, "").otherwise((F.col("k") * 500).cast("string"))
    return events(spark, sf_dir).select("event_id", "participantid", F.date_format("measuredat", "yyyy-MM-dd HH:mm:ss").alias("value0"), seconds.alias("value1"), F.coalesce(label[F.col("event_type")], F.col("event_type")).alias("value2"))


def accelerometer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in g; `_id` is the event's number."""
    return events(spark, sf_dir).select(
        F.col("event_id").alias("_id"), "user_id", "participantid", "measuredat", (F.col("value") / 100).alias("acc_x"), (F.col("k") / 100).alias("acc_y"), ((F.col("event_id") % 7) / 7).alias("acc_z")
    )


def location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed coordinates; the zone depends on participant and part of the month."""
    third = F.pmod(F.col("user_id") + F.floor((F.dayofmonth("measuredat") - 1) / 10), F.lit(3))
    zone = F.when(third == 0, "America/Halifax").when(third == 1, "UTC").otherwise("Unknown_Timezone")
    packed = F.format_string("%.6f | %.6f | 0", 44 + F.col("value") / 100, -63 + F.col("k") / 100)
    return events(spark, sf_dir).select(F.col("event_id").alias("_id"), "user_id", "participantid", "measuredat", packed.alias("location_decrypted"), zone.alias("timezone_id"))


def device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(participantid, device_type): even users on android, odd on ios, every fiftieth on both."""
    users = events(spark, sf_dir).select("user_id", "participantid").distinct()
    own = users.select("participantid", F.when(F.col("user_id") % 2 == 0, "android").otherwise("ios").alias("device_type"))
    return own.unionByName(users.where("user_id % 50 = 0").select("participantid", F.lit("ios").alias("device_type")))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten questionnaire scores by participant."""
    users = events(spark, sf_dir).select("user_id", "participantid").distinct()
    names = ("emo_symptoms", "hyperactivity", "conduct_probs", "peer_probs", "prosocial")
    made = [F.pmod(F.col("user_id") * (2 * i + 3) + 7 * j, F.lit(11)).cast("int").alias(f"{n}_{w}") for j, w in enumerate(("baseline", "followup")) for i, n in enumerate(names)]
    return users.select("participantid", *made)
