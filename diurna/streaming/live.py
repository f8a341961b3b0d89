"""Sessions and daily features over streams, with bounded state.

The sources are batch tables; these are the forms for live input. State is kept for each participant
and given up when the watermark has passed the longest session; events count in the order of their
times if they come in within the time allowed for late ones.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Thresholds
from ..functions.times import sensing_date
from ..functions.values import screen_label
from ..sources.sinks import upsert

T = Thresholds()
SESSION = "participantid string, measuredat timestamp, next_measuredat timestamp, screen_on_time_in_secs long"


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once within the time that copies may be late."""
    return events.withWatermark("measuredat", late).dropDuplicatesWithinWatermark(["participantid", "measuredat", "value0"])


def screen_sessions(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Unlocked events directly followed by a locked one, whatever the order in which they come in.

    Events wait until the watermark has passed them, so each is paired with the one that follows in
    time. The state of a participant is the last event passed and those that wait.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, waiting = None, []
        if state.exists:
            at, value, held = state.get
            before, waiting = (at, value) if value is not None else None, json.loads(held)
        for rows in frames:
            waiting += [[at.value // 1000, value] for at, value in zip(rows["measuredat"], rows["value0"], strict=True)]
        now = state.getCurrentWatermarkMs()
        due = sorted((x for x in waiting if x[0] <= now * 1000), key=lambda x: (x[0], x[1] is not None, x[1] or ""))
        waiting = [x for x in waiting if x[0] > now * 1000]
        out = []
        for at, value in due:
            if before is not None and before[1] == "unlocked" and value == "locked":
                seconds = at // 1_000_000 - before[0] // 1_000_000
                if 0 < seconds <= T.max_session_s:
                    out.append((key[0], pd.Timestamp(before[0] * 1000), pd.Timestamp(at * 1000), seconds))
            before = (at, value)
        # woken when the next event that waits is passed, or when the last one can begin no session any more
        ends = before[0] // 1000 + T.max_session_s * 1000 if before else 0
        if not waiting and ends <= now:
            state.remove()
        else:
            state.update((before[0] if before else 0, before[1] if before else None, json.dumps(waiting)))
            state.setTimeoutTimestamp(max(min(x[0] for x in waiting) // 1000 if waiting else ends, now + 1))
        if out:
            yield pd.DataFrame(out, columns=["participantid", "measuredat", "next_measuredat", "screen_on_time_in_secs"])

    labelled = events.select("participantid", "measuredat", screen_label(F.col("value0")).alias("value0")).withWatermark("measuredat", late)
    return labelled.groupBy("participantid").applyInPandasWithState(step, SESSION, "at long, value0 string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def daily_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by participant and 6AM day: windows of a day that start at 6AM."""
    by_day = F.window("measuredat", "1 day", startTime="6 hours")
    out = events.withWatermark("measuredat", late).groupBy("participantid", by_day.alias("w")).agg(F.count("*").alias("n"))
    return out.select("participantid", F.to_date(F.col("w.start")).alias("date_local"), "n")


def merge_into(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges each batch by key, so a batch that runs twice changes nothing."""

    def run(batch: DataFrame, _: int) -> None:
        upsert(batch, path, keys)

    return run


def day_of(events: DataFrame) -> DataFrame:
    """Adds the 6AM day to a stream whose times are local."""
    return events.withColumn("date_local", sensing_date(F.col("measuredat")))
