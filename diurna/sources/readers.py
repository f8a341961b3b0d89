"""Readers. Columns are selected and filters stated at the scan, so that files are read no further than needed."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import any_timestamp, parse_timestamp
from ..functions.values import CUTOFFS


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_event_data(source: DataFrame) -> DataFrame:
    """(participantid, measuredat, value0) of a sensor's events; times as text, unix seconds or timestamps."""
    kind = source.schema["measuredat"].dataType.simpleString()
    return source.select(F.col("participantid").cast("string").alias("participantid"), any_timestamp(kind, F.col("measuredat")).alias("measuredat"), "value0")


def read_timezone_data(source: DataFrame) -> DataFrame:
    return source.select("participantid", "timezone_id", F.col("start_time").cast("timestamp").alias("start_time"), F.col("end_time").cast("timestamp").alias("end_time"))


def read_accelerometer_data(source: DataFrame) -> DataFrame:
    kind = source.schema["measuredat"].dataType.simpleString()
    axes = (F.col(f"value{i}").cast("double").alias(f"acc_{c}") for i, c in enumerate("xyz"))
    return source.select("_id", "participantid", any_timestamp(kind, F.col("measuredat")).alias("measuredat"), *axes)


def read_location_data(source: DataFrame) -> DataFrame:
    """Locations with both times parsed from any of three text forms."""
    return source.select("_id", "participantid", parse_timestamp(F.col("measuredat")).alias("measuredat"), parse_timestamp(F.col("uploadedat")).alias("uploadedat"), "value0", "location_decrypted", "timezone_id")


def of_participants(source: DataFrame, participants: list[str]) -> DataFrame:
    """Rows of these participants; the list reaches the scan."""
    return source.where(F.col("participantid").isin(*participants))


def distinct_participants(source: DataFrame) -> DataFrame:
    return source.select("participantid").distinct().orderBy("participantid")


def batch_numbers(participants: DataFrame, size: int) -> DataFrame:
    """(participantid, batch): distinct participants in order, numbered in batches of `size` from 1.

    They are ranked side by side in groups of a common beginning, a few characters longer than what all
    have in common; the groups, which are few, are numbered in one place.
    """
    ids = participants.select("participantid").where("participantid is not null").distinct()
    ends = ids.agg(F.min("participantid"), F.max("participantid")).first()
    same = len(os.path.commonprefix([ends[0] or "", ends[1] or ""]))
    ids = ids.withColumn("_group", F.substring("participantid", 1, same + 2))
    groups = ids.groupBy("_group").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_group")) - F.col("_n"))
    rank = F.row_number().over(Window.partitionBy("_group").orderBy("participantid"))
    return ids.withColumn("_rank", rank).join(groups, "_group").select("participantid", (F.floor((F.col("_before") + F.col("_rank") - 1) / size) + 1).alias("batch"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a dataset can be read; optional inputs are skipped if not."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def query(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    """SQL over frames given by name."""
    return spark.sql(text, **views) if views else spark.sql(text)


SCORES = T.StructType([T.StructField("redcap_survey_identifier", T.StringType())] + [T.StructField(f"{s}_{when}", T.IntegerType()) for when in ("baseline", "followup") for s in CUTOFFS])


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Questionnaire scores from a CSV file with a header."""
    return spark.read.csv(path, header=True, schema=SCORES, enforceSchema=False)


def batches(df: DataFrame, rows: int) -> Iterator[list[Row]]:
    """Rows in lists of this length, fetched partition by partition."""
    batch: list[Row] = []
    for row in df.toLocalIterator():
        batch.append(row)
        if len(batch) == rows:
            yield batch
            batch = []
    if batch:
        yield batch
