"""Sessions and calls from sequences of events of one participant.

Ties in time are ordered by the label, so that results do not depend on how rows arrive. A filter
after lead() must stay after it, as it changes who is next to whom. Events are dealt by participant before
copies are dropped, so that all later steps of a participant need no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.times import event_times
from ..functions.values import screen_label, terminations
from .intervals import best_zone

T = Thresholds()


def by_time() -> WindowSpec:
    return Window.partitionBy("participantid").orderBy("measuredat", "value0")


def pairs(events: DataFrame, first: str = "unlocked", second: str = "locked", limit: int = T.max_session_s) -> DataFrame:
    """An event `first` directly followed by `second`, more than 0 and at most `limit` seconds apart."""
    ahead = events.select("participantid", "measuredat", "value0", F.lead("value0").over(by_time()).alias("next_value0"), F.lead("measuredat").over(by_time()).alias("next_measuredat"))
    spans = ahead.where((F.col("value0") == first) & (F.col("next_value0") == second))
    seconds = F.unix_timestamp("next_measuredat") - F.unix_timestamp("measuredat")
    return spans.select("participantid", "measuredat", "next_measuredat", seconds.alias("screen_on_time_in_secs")).where((F.col("screen_on_time_in_secs") > 0) & (F.col("screen_on_time_in_secs") <= limit))


def screen_sessions_android(power: DataFrame, segments: DataFrame, compat: bool = False) -> DataFrame:
    """Sessions from screen states: labels made alike, copies dropped, pairs found, local times added."""
    events = power.select("participantid", "measuredat", screen_label(F.col("value0")).alias("value0")).repartition("participantid").dropDuplicates()
    found = best_zone(pairs(events), segments).dropDuplicates(["participantid", "measuredat", "next_measuredat"])
    return event_times(found, compat)


def screen_sessions_ios(lock: DataFrame, analytics: DataFrame | None, segments: DataFrame, compat: bool = False) -> DataFrame:
    """Sessions from lock states. An app's end never closes a session; it comes between and breaks a pair."""
    columns = ["participantid", "measuredat", "value0"]
    events = lock.select("participantid", "measuredat", F.lower("value0").alias("value0"))
    if analytics is not None:
        events = events.unionByName(terminations(analytics.select(columns)))
    found = best_zone(pairs(events.repartition("participantid").dropDuplicates()), segments).dropDuplicates(["participantid", "measuredat", "next_measuredat"])
    return event_times(found, compat)


def call_sequences(events: DataFrame, limit: int = T.max_call_s) -> DataFrame:
    """All calls and anomalies in one pass over three successive events.

    `kind` is call or anomaly. Answered: ringing or dialling, connected, disconnected; its duration
    is the whole span. Unanswered: disconnected at once and not connected next; its duration is 0.
    Spans are below `limit`; an answered pattern with a longer span is an anomaly.
    """
    ahead = events.select(
        "participantid", "measuredat", "timezone_id", F.upper("value0").alias("first"),
        F.upper(F.lead("value0").over(by_time())).alias("second"), F.upper(F.lead("value0", 2).over(by_time())).alias("third"),
        F.lead("measuredat").over(by_time()).alias("second_time"), F.lead("measuredat", 2).over(by_time()).alias("third_time"),
    )
    span = lambda c: F.unix_timestamp(c) - F.unix_timestamp("measuredat")
    way = F.when(F.col("first") == "CALL_INCOMING", "incoming").when(F.col("first") == "CALL_DIALING", "outgoing")
    answered = (F.col("second") == "CALL_CONNECTED") & (F.col("third") == "CALL_DISCONNECTED")
    unanswered = (F.col("second") == "CALL_DISCONNECTED") & (F.col("third").isNull() | (F.col("third") != "CALL_CONNECTED")) & (span("second_time") < limit)
    kind = F.when(answered & (span("third_time") < limit), "call").when(answered, "anomaly").when(unanswered, "call")
    out = ahead.withColumn("way", way).withColumn("kind", kind).where(F.col("way").isNotNull() & F.col("kind").isNotNull())
    return out.select(
        "participantid", "kind", "timezone_id",
        F.col("measuredat").alias("call_start"),
        F.when(answered, F.col("second_time")).alias("call_connected"),
        F.when(answered, F.col("third_time")).otherwise(F.col("second_time")).alias("call_end"),
        F.concat("way", F.when(answered, F.lit("_call_answered")).otherwise(F.lit("_call_unanswered"))).alias("call_type"),
        F.when(answered, span("third_time")).otherwise(F.lit(0)).cast("long").alias("call_duration_in_secs"),
    )


def calls_ios(calls: DataFrame, analytics: DataFrame | None, segments: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(calls with times, anomalies) from call states; an app's end counts as a disconnection."""
    columns = ["participantid", "measuredat", "value0"]
    events = calls.select(columns)
    if analytics is not None:
        events = events.unionByName(terminations(analytics.select(columns), "CALL_DISCONNECTED"))
    found = call_sequences(best_zone(events.repartition("participantid").dropDuplicates(columns), segments))
    valid = found.where("kind = 'call'").select("participantid", F.col("call_start").alias("measuredat"), F.col("call_end").alias("next_measuredat"), "timezone_id", "call_type", "call_duration_in_secs")
    return event_times(valid, compat), found.where("kind = 'anomaly'").drop("kind")
