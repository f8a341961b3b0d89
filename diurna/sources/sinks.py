"""Sinks: append, replace, and merge by key into datasets of files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import exists

SQL_TYPES = {T.StringType: "TEXT", T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.DoubleType: "DOUBLE PRECISION", T.FloatType: "REAL", T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.BooleanType: "BOOLEAN"}


def sql_type(kind: T.DataType) -> str:
    """Name of a type in DDL; unknown types are text."""
    if isinstance(kind, T.DecimalType):
        return f"NUMERIC({kind.precision},{kind.scale})"
    return SQL_TYPES.get(type(kind), "TEXT")


def scratch(spark: SparkSession) -> str:
    """A new path for data that a session needs no longer than it lasts, in the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    files, at = _files(spark, path)
    files.mkdirs(at(path))
    files.deleteOnExit(at(path))
    return path


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the greatest by all other columns, so the choice is the same in every run."""
    others = [F.col(f"`{c}`").desc_nulls_last() for c in df.columns if c not in keys]
    order = Window.partitionBy(*keys).orderBy(*(others or [F.lit(1)]))
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def merged(existing: DataFrame, new: DataFrame, keys: list[str], mode: str = "update", keep: tuple[str, ...] = ()) -> DataFrame:
    """What a table holds after new rows are merged by key.

    update: new rows replace those of their key (columns in `keep` stay as they were); ignore: only
    rows of new keys are added; append: all are added.
    """
    if mode == "append":
        return existing.unionByName(new)
    new = one_per_key(new, keys).select(existing.columns)
    if mode == "ignore":
        return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti"))
    if mode != "update":
        raise ValueError(mode)
    if keep:
        old = existing.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in keep), F.lit(True).alias("_had"))
        new = new.join(old, keys, "left").select(*(F.when(F.col("_had"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in existing.columns))
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and constructor of its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _aside(path: str) -> str:
    return f"{path.rstrip('/')}.before"


def recovered(spark: SparkSession, path: str) -> None:
    """Ends a replacement that was broken off: the dataset is the new one if that is in place, else the old one."""
    files, at = _files(spark, path)
    if files.exists(at(_aside(path))):
        if files.exists(at(path)):
            files.delete(at(_aside(path)), True)
        elif not files.rename(at(_aside(path)), at(path)):
            raise OSError(f"cannot restore {path}")


def replace_by(spark: SparkSession, staged: str, path: str) -> None:
    """Puts the dataset at `staged` in place of the one at path, which is moved aside first and deleted last."""
    files, at = _files(spark, path)
    if files.exists(at(path)) and not files.rename(at(path), at(_aside(path))):
        raise OSError(f"cannot move {path} aside")
    if not files.rename(at(staged), at(path)):
        recovered(spark, path)
        raise OSError(f"cannot move {staged} to {path}")
    files.delete(at(_aside(path)), True)
    spark.catalog.refreshByPath(path)


def upsert(df: DataFrame, path: str, keys: list[str], mode: str = "update", keep: tuple[str, ...] = ()) -> None:
    """Merges df into the dataset at path. The new state is written beside the old one and then takes its place.

    One writer at a time; if it breaks off at any point, the next one finds the old state or the new.
    """
    spark = df.sparkSession
    recovered(spark, path)
    if not exists(spark, path):
        overwrite(one_per_key(df, keys), path)
        return
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    overwrite(merged(spark.read.parquet(path), df, keys, mode, keep), staged)
    replace_by(spark, staged, path)


def create_table_if_not_exists(spark: SparkSession, name: str, schema: T.StructType) -> None:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet")


def with_column_added(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def filled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Computes a column only where it is missing."""
    return df.withColumn(name, F.coalesce(F.col(name), value))
