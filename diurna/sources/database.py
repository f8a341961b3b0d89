"""Tables of a database, read and written over JDBC."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .sinks import one_per_key

#: Rows that a fetch or an insert moves at once.
ROWS = 1000


def read(spark: SparkSession, url: str, table: str, by: str | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A table or a query in parentheses. Filters and the choice of columns are left to the database.

    With a numeric, date or time column `by`, the table is read by `parts` tasks, each a range of it.
    """
    table = f"{table} q" if table.startswith("(") else table
    base = {"url": url, "fetchsize": str(ROWS), **options}
    reader = spark.read.format("jdbc").options(**base).option("dbtable", table)
    if by is None or parts <= 1:
        return reader.load()
    name = quoted(by)
    ends = spark.read.format("jdbc").options(**base).option("dbtable", f"(SELECT min({name}) AS lo, max({name}) AS hi FROM {table}) e").load().first()
    if ends[0] is None:
        return reader.load()
    return reader.options(partitionColumn=by, lowerBound=str(ends[0]), upperBound=str(ends[1]), numPartitions=str(parts)).load()


def write(df: DataFrame, url: str, table: str, mode: str = "append", parts: int | None = None, **options: str) -> None:
    """Appends to a table, or with mode "overwrite" makes it anew. `parts` bounds the connections."""
    rows = df if parts is None else df.coalesce(parts)
    rows.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(ROWS), **options).mode(mode).save()


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@contextmanager
def connection(spark: SparkSession, url: str, **options: str) -> Iterator:
    jvm = spark.sparkContext._jvm
    own = jvm.java.util.Properties()
    for k, v in options.items():
        own.setProperty(k, v)
    opened = jvm.java.sql.DriverManager.getConnection(url, own)
    try:
        yield opened
    finally:
        opened.close()


def execute(spark: SparkSession, url: str, *statements: str, **options: str) -> None:
    """Runs statements in one transaction."""
    with connection(spark, url, **options) as opened:
        opened.setAutoCommit(False)
        try:
            for text in statements:
                statement = opened.createStatement()
                statement.execute(text)
                statement.close()
            opened.commit()
        except Exception:
            opened.rollback()
            raise


def merge_statement(url: str, table: str, staged: str, columns: list[str], keys: list[str], mode: str, keep: tuple[str, ...]) -> str:
    """One statement that merges a staged table by key, in the database's own dialect."""
    names = ", ".join(map(quoted, columns))
    changed = [c for c in columns if c not in keys and c not in keep] if mode == "update" else []
    if url.startswith("jdbc:postgresql:"):
        action = "DO UPDATE SET " + ", ".join(f"{quoted(c)} = excluded.{quoted(c)}" for c in changed) if changed else "DO NOTHING"
        return f"INSERT INTO {table} ({names}) SELECT {names} FROM {staged} ON CONFLICT ({', '.join(map(quoted, keys))}) {action}"
    on = " AND ".join(f"t.{quoted(k)} = s.{quoted(k)}" for k in keys)
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{quoted(c)} = s.{quoted(c)}' for c in changed)}" if changed else ""
    return f"MERGE INTO {table} t USING {staged} s ON {on}{update} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({', '.join(f's.{quoted(c)}' for c in columns)})"


def upsert(df: DataFrame, url: str, table: str, keys: list[str], mode: str = "update", keep: tuple[str, ...] = (), **options: str) -> None:
    """Merges df into a table by key: update replaces rows of known keys but for the columns in `keep`, ignore leaves them.

    The rows go to a table of their own first, by all tasks, and are merged by one statement in one
    transaction, so tasks that run twice or break off change nothing.
    """
    if mode not in ("update", "ignore"):
        raise ValueError(mode)
    staged = quoted(f"staged_{uuid.uuid4().hex[:12]}")
    own = {k: v for k, v in options.items() if k in ("user", "password", "driver")}
    try:
        write(one_per_key(df, keys), url, staged, "overwrite", **options)
        execute(df.sparkSession, url, merge_statement(url, table, staged, df.columns, keys, mode, keep), **own)
    finally:
        execute(df.sparkSession, url, f"DROP TABLE {staged}", **own)
