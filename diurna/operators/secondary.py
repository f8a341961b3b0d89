"""Statistics of each participant over days, and clinical categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import CUTOFFS, category
from .merging import SCORE_COLUMNS

STATISTICS = ("mean", "median", "sd", "iqr", "cv", "rmssd", "mad", "range", "above_median", "below_median", "entropy")
#: Factor that makes the median absolute deviation estimate a standard deviation. Fixed value.
MAD_FACTOR = 1.4826


def long_form(days: DataFrame, columns: list[str], key: str = "participantid", order: str = "date_local", gaps: bool = False) -> DataFrame:
    """(key, order, feature, x): one row for each known value; with `gaps` also one, without x, for each unknown value."""
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns))
    rows = days.select(key, order, F.explode(pairs).alias("p")).select(key, order, "p.feature", "p.x")
    return rows.withColumn("x", F.when(~F.isnan("x"), F.col("x"))) if gaps else rows.where("x is not null and not isnan(x)")


def summed_in_order(rows: DataFrame, keys: list[str], order: list[str], column: str, *others: Column) -> DataFrame:
    """(keys, column, others): sums of a column whose rows are added one by one in this order, and other aggregates.

    The last digits of a sum of doubles depend on its order. Added as rows arrive, equal rows would have sums that
    differ between participants, and between the passes of one query, which breaks ties and comparisons with a median.
    """
    by = Window.partitionBy(*keys).orderBy(*order, column)
    running = rows.withColumn("_at", F.row_number().over(by)).withColumn("_sum", F.sum(column).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return running.groupBy(*keys).agg(F.max_by("_sum", "_at").alias(column), *others)


def pretty_step(low: Column, high: Column, bins: int = 10) -> Column:
    """Width of about `bins` round intervals over a range: 1, 2 or 5 (or 10) times a power of ten.

    The next unit up is taken where it is nearer by the usual bias of 1.5.
    """
    cell = F.greatest(F.abs(low), F.abs(high))
    raw = F.when(high > low, (high - low) / bins).otherwise(F.when(cell > 0, cell / bins).otherwise(0.1))
    base = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    bias, bias5 = 1.5, 0.5 + 1.5 * 1.5
    return (
        F.when(10 * base - raw < bias * (raw - 5 * base), 10 * base)
        .when(5 * base - raw < bias5 * (raw - 2 * base), 5 * base)
        .when(2 * base - raw < bias * (raw - base), 2 * base)
        .otherwise(base)
    )


def histogram_place(x: Column, low: Column, step: Column) -> Column:
    """The interval of a value, closed on the right; the lowest break belongs to the first interval."""
    return F.greatest(F.ceil(x / step - 1e-7) - 1, F.floor(low / step + 1e-7))


def histogram_entropy(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, entropy): Shannon entropy in bits of a histogram with round breaks, closed on the right."""
    spread = values.groupBy(*keys).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    spread = spread.select(*keys, "low", pretty_step(F.col("low"), F.col("high")).alias("step"))
    binned = values.join(spread, keys)
    counts = binned.groupBy(*keys, histogram_place(F.col("x"), F.col("low"), F.col("step")).alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n")
    return counts.groupBy(*keys).agg((F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy"))


#: Intervals of a histogram at most: steps are at least 0.71 tenths of the range, so it has 14 and one at either end.
MOST_BINS = 16


def statistics(values: DataFrame, key: str = "participantid", order: str = "date_local") -> DataFrame:
    """(key, feature, statistics...) from long values, in two passes: the second needs the medians and the range.

    Differences are those of successive rows: a row without x leaves out both of its own, and counts nowhere else.
    """
    keys = [key, "feature"]
    before = F.lag("x").over(Window.partitionBy(*keys).orderBy(order))
    first = values.withColumn("d", F.col("x") - before).groupBy(*keys).agg(
        F.avg("x").alias("mean"),
        F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.stddev_samp("x").alias("sd"),
        F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmssd"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
    )
    first = first.select(
        *keys, "mean", F.col("q")[1].alias("median"), "sd", (F.col("q")[2] - F.col("q")[0]).alias("iqr"), F.when(F.col("mean") != 0, F.try_divide("sd", "mean")).alias("cv"), "rmssd",
        (F.col("high") - F.col("low")).alias("range"), "low", pretty_step(F.col("low"), F.col("high")).alias("step"),
    )
    whole = ("mean", "median", "sd", "iqr", "cv", "rmssd", "range")
    bin_ = histogram_place(F.col("x"), F.col("low"), F.col("step")) - histogram_place(F.col("low"), F.col("low"), F.col("step"))
    second = values.join(first, keys).groupBy(*keys).agg(
        *(F.first(c).alias(c) for c in whole),
        (F.lit(MAD_FACTOR) * F.percentile(F.abs(F.col("x") - F.col("median")), F.lit(0.5))).alias("mad"),
        F.count_if(F.col("x") > F.col("median")).alias("above_median"),
        F.count_if(F.col("x") < F.col("median")).alias("below_median"),
        F.array(*(F.count_if(bin_ == k) for k in range(MOST_BINS))).alias("bins"),
        F.count("x").alias("n"),
    )
    spread = F.aggregate("bins", F.lit(0.0), lambda acc, m: acc + F.when(m > 0, m * F.log2(m.cast("double"))).otherwise(0.0))
    return second.withColumn("entropy", F.log2("n") - F.try_divide(spread, F.col("n"))).select(*keys, *STATISTICS)


def numeric_columns(df: DataFrame, but: list[str]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in but]


def participant_features(days: DataFrame, columns: list[str] | None = None, first: list[str] | None = None, gaps: bool = False) -> DataFrame:
    """One row for each participant: number of days, all statistics of all columns, first known value of static columns.

    With `gaps` a day of an unknown value parts the days around it, and who has no known value has counts of 0.
    """
    first = [c for c in (first if first is not None else ["device_type", *SCORE_COLUMNS]) if c in days.columns]
    columns = columns or numeric_columns(days, ["participantid", *first])
    table = statistics(long_form(days, columns, gaps=gaps))
    wide = table.groupBy("participantid").pivot("feature", columns).agg(*(F.first(s).alias(s) for s in STATISTICS))
    known = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("date_local"))).alias(c) for c in first]
    base = days.groupBy("participantid").agg(F.count("*").alias("available_days"), *known)
    return base.join(wide, "participantid", "left")


def with_categories(features: DataFrame) -> DataFrame:
    """Adds a category for each score."""
    return features.withColumns({f"{s}_{w}_cat": category(s, F.col(f"{s}_{w}")) for w in ("baseline", "followup") for s in CUTOFFS if f"{s}_{w}" in features.columns})


#: Values that are ranked in one task at most.
RANKED = 100_000


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of a column, with linear interpolation between ranks, however many values there are.

    Around each quantile a range is narrowed by approximate quantiles, whose error is bounded, until it
    holds few enough values to rank them, or nothing but equal ones.
    """
    x = F.col(column)
    known = df.select(x.cast("double").alias("x")).where("x is not null and not isnan(x)")
    n = known.count()
    if n <= RANKED:
        return list(known.agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("q")).first().q or [None] * len(shares))
    out = []
    for share in shares:
        part, below, inside, margin = known, 0, n, 2e-4
        while inside > RANKED:
            at = (share * (n - 1) - below) / (inside - 1)
            low, high = part.agg(F.percentile_approx("x", [max(0.0, at - margin), min(1.0, at + margin)], 10_000)).first()[0]
            less, kept = part.agg(F.count_if(F.col("x") < low), F.count_if(F.col("x").between(low, high))).first()
            if kept == inside:
                break
            part, below, inside = part.where(F.col("x").between(low, high)), below + less, kept
        at = (share * (n - 1) - below) / max(inside - 1, 1)
        out.append(part.agg(F.percentile("x", F.lit(min(max(at, 0.0), 1.0)))).first()[0])
    return out


def iqr_outliers(df: DataFrame, column: str, key: list[str]) -> DataFrame:
    """Rows beyond 1.5 interquartile ranges from the quartiles."""
    q1, q3 = quantiles(df, column, [0.25, 0.75])
    if q1 is None:
        return df.select(*key, column, *(F.lit(None).cast("double").alias(c) for c in ("lower", "upper"))).limit(0)
    lower, upper = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    return df.where((F.col(column) < lower) | (F.col(column) > upper)).select(*key, column, F.lit(lower).alias("lower"), F.lit(upper).alias("upper"))
