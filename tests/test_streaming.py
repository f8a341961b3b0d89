"""Streams give what batches give."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from diurna.operators import sequences
from diurna.streaming import live

START = datetime(2024, 1, 1, 5)


def source(spark, folder, rows, files=3):
    df = spark.createDataFrame(rows, "participantid string, measuredat timestamp, value0 string")
    for i in range(files):
        df.where(F.col("measuredat").between(START + timedelta(hours=4 * i), START + timedelta(hours=4 * i + 3, minutes=59))).coalesce(1).write.mode("append").parquet(folder)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def ended(batch, late=timedelta(hours=1)):
    """Sessions of a batch that end before what a stream may still wait for."""
    limit = batch.agg(F.max("measuredat")).first()[0] - late
    events = batch.withColumn("value0", F.when(F.col("value0") == "screen_on", "unlocked").otherwise("locked"))
    return sorted(map(tuple, sequences.pairs(events).where(F.col("next_measuredat") <= F.lit(limit)).collect()))


def test_sessions_of_a_stream(spark, tmp_path):
    rows = [(str(p), START + timedelta(minutes=17 * i + p), "screen_on" if (i * (p + 1)) % 3 else "screen_off") for p in range(3) for i in range(40)]
    batch, stream = source(spark, str(tmp_path / "in"), rows)
    run(live.screen_sessions(stream), "sessions")
    assert sorted(map(tuple, spark.table("sessions").collect())) == ended(batch) != []


def test_late_events_are_paired_in_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(str(p), START + timedelta(minutes=7 * i, seconds=p), rng.choice(["screen_on", "screen_off"])) for p in range(4) for i in range(60)]
    folder = str(tmp_path / "in")
    batch = spark.createDataFrame(rows, "participantid string, measuredat timestamp, value0 string")
    for n in range(10):  # files overlap: each event may come up to 40 minutes late
        part = [r for r in rows if (int((r[1] - START).total_seconds()) + r[1].minute * 41 % 2400) // 3000 == n]
        if part:
            spark.createDataFrame(part, batch.schema).coalesce(1).write.mode("append").parquet(folder)
    run(live.screen_sessions(spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder)), "late")
    assert sorted(map(tuple, spark.table("late").collect())) == ended(batch) != []


def test_daily_counts_and_idempotent_merge(spark, tmp_path):
    rows = [("a", START + timedelta(minutes=50 * i), "x") for i in range(12)]
    _, stream = source(spark, str(tmp_path / "in"), rows)
    out = str(tmp_path / "out")
    q = live.daily_counts(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(live.merge_into(out, ["participantid", "date_local"])).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {str(r.date_local): r.n for r in spark.read.parquet(out).collect()}
    assert got == {"2023-12-31": 2, "2024-01-01": 10}


def test_copies_are_dropped(spark, tmp_path):
    rows = [("a", START, "x"), ("a", START, "x"), ("a", START + timedelta(minutes=1), "x")]
    _, stream = source(spark, str(tmp_path / "in"), rows, 1)
    run(live.deduplicated(stream), "once")
    assert spark.table("once").count() == 2
