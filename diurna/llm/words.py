"""Words and rolling word hashes as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast: counted before it is.
BROADCAST_ROWS = 200_000
#: Bytes that a table may hold to be broadcast, and rows of one key that one task joins.
BROADCAST_BYTES = 32 << 20
SPREAD = 20_000


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and keeps ASCII letters out of all else.

    lower() does the same for ASCII; of other letters only two turn into ASCII letters, and texts
    with those take the slower way.
    """
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    return F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def rolling(words: Column, k: int) -> Column:
    """A hash of each k successive words."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))
    if k == 1:
        return F.transform(words, lambda w: F.xxhash64(w))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, k))))


def small(table: DataFrame, rows: int, width: int | None = None) -> DataFrame:
    """The table, marked for broadcast if it has few enough rows; if no row is wider than `width` bytes, few enough bytes."""
    few = rows <= BROADCAST_ROWS if width is None else rows * width <= BROADCAST_BYTES
    return F.broadcast(table) if few else table


def spread_join(left: DataFrame, right: DataFrame, key: str, by: list[str]) -> DataFrame:
    """left joined to right, which has one row for each key with `n`, the number of left's rows of that key.

    A key with over SPREAD rows is dealt to several tasks by the columns `by`; there is at most one
    such key for each SPREAD rows. `n` is dropped.
    """
    salts = F.greatest(F.ceil(F.col("n") / SPREAD).cast("int"), F.lit(1))
    busy = right.where(F.col("n") > SPREAD).select(key, salts.alias("_salts"))
    left = left.join(small(busy, busy.count()), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    return left.join(right, [key, "_salt"]).drop("_salt")
