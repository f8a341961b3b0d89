"""Screening of features and post-hoc statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(partition: list[str], order: str) -> Column:
    """Ranks in which equal values share the mean of their places."""
    by = Window.partitionBy(*partition).orderBy(order)
    peers = Window.partitionBy(*partition, order)
    return F.rank().over(by) + (F.count("*").over(peers) - 1) / 2


def spearman(values: DataFrame, key: str = "participantid") -> DataFrame:
    """(a, b, rho, n) for all pairs of features of long values (key, feature, x).

    Ranks are taken anew for each pair, over the keys that have both. The pairs are of features,
    whose number is fixed by the schema; rows are joined by key.
    """
    left, right = values.select(key, F.col("feature").alias("a"), F.col("x").alias("xa")), values.select(key, F.col("feature").alias("b"), F.col("x").alias("xb"))
    both = left.join(right, key).where("a < b")
    ranked = both.select("a", "b", average_rank(["a", "b"], "xa").alias("ra"), average_rank(["a", "b"], "xb").alias("rb"))
    return ranked.groupBy("a", "b").agg(F.corr("ra", "rb").alias("rho"), F.count("*").alias("n"))


def clusters(correlations: pd.DataFrame, features: list[str], height: float = 0.1) -> dict[str, int]:
    """Average-linkage clusters of features at distance 1 - |rho|, cut at `height`; numbered by first member."""
    at = {f: i for i, f in enumerate(features)}
    n = len(features)
    d = np.ones((n, n))
    np.fill_diagonal(d, 0)
    for a, b, rho in correlations[["a", "b", "rho"]].itertuples(index=False):
        if a in at and b in at and rho is not None and not math.isnan(rho):
            d[at[a], at[b]] = d[at[b], at[a]] = 1 - abs(rho)
    groups = {i: [i] for i in range(n)}
    while len(groups) > 1:
        keys = list(groups)
        best = min(((d[np.ix_(groups[x], groups[y])].mean(), x, y) for k, x in enumerate(keys) for y in keys[k + 1 :]), default=None)
        if best is None or best[0] > height:
            break
        groups[best[1]] += groups.pop(best[2])
    out = {}
    for number, members in enumerate(sorted(groups.values(), key=min)):
        out |= {features[i]: number for i in members}
    return out


def representatives(numbers: dict[str, int], features: list[str]) -> list[str]:
    """The first feature of each cluster."""
    seen: set[int] = set()
    return [f for f in features if not (numbers[f] in seen or seen.add(numbers[f]))]


def kruskal(values: DataFrame, group: str = "outcome", compat: bool = False) -> DataFrame:
    """(feature, h, k, n, p, epsilon2) of long values (feature, group, x), with correction for ties.

    With `compat` the effect size counts no groups, as for an outcome that is text.
    """
    ranked = values.where("x is not null").withColumn("r", average_rank(["feature"], "x")).withColumn("ties", F.count("*").over(Window.partitionBy("feature", "x")))
    by_group = ranked.groupBy("feature", group).agg(F.sum("r").alias("sum"), F.count("*").alias("m"), F.sum(F.col("ties") * F.col("ties") - 1).alias("t"))
    out = by_group.groupBy("feature").agg(F.sum(F.col("sum") * F.col("sum") / F.col("m")).alias("s"), F.sum("m").alias("n"), F.sum("t").alias("t"), F.count("*").alias("k"))
    n = F.col("n")
    raw = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    h = F.try_divide(raw, 1 - F.col("t") / (n * n * n - n))
    levels = F.lit(0) if compat else F.col("k")
    out = out.select("feature", h.alias("h"), "k", "n").withColumn("epsilon2", F.greatest(F.lit(0.0), (F.col("h") - (levels - 1)) / (n - 1)))
    return out.withColumn("p", chi2_tail(F.col("h"), F.col("k") - 1))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution, in closed form by whole or half steps."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        term = total = math.exp(-x / 2)
        for k in range(1, df // 2):
            term *= x / 2 / k
            total += term
        return total
    total = math.erfc(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, (df - 1) // 2 + 1):
        total += term
        term *= x / (2 * k + 1)
    return total


def _chi2(h: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def tail(h: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi2_sf(x, int(k)) if x == x and x is not None else None for x, k in zip(h, df, strict=True)], dtype="float64")

    return tail(h.cast("double"), df.cast("int"))


def chi2_tail(h: Column, df: Column) -> Column:
    """For one to three groups in closed form on columns; for more by a function on few rows."""
    return F.when(df == 2, F.exp(-h / 2)).when(df <= 0, F.lit(1.0)).otherwise(_chi2(h, df))


def bh_adjusted(tests: DataFrame, p: str = "p", partition: list[str] | None = None) -> DataFrame:
    """Adds q: p-values adjusted for the number of tests, made monotone from the largest down."""
    part = partition or []
    n = F.count("*").over(Window.partitionBy(*part))
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(p))
    scaled = tests.withColumn("_scaled", F.col(p) * n / rank).withColumn("_rank", rank)
    down = Window.partitionBy(*part).orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return scaled.withColumn("q", F.least(F.lit(1.0), F.min("_scaled").over(down))).drop("_scaled", "_rank")


def dunn(values: DataFrame, group: str = "outcome") -> DataFrame:
    """(feature, a, b, z, p, q) for all pairs of groups, with the tie term, adjusted within each feature.

    p is one-sided, the chance of a z at least as far out on its side.
    """
    ranked = values.where("x is not null").withColumn("r", average_rank(["feature"], "x")).withColumn("ties", F.count("*").over(Window.partitionBy("feature", "x")))
    means = ranked.groupBy("feature", F.col(group).alias("g")).agg(F.avg("r").alias("mean"), F.count("*").alias("m"))
    whole = ranked.groupBy("feature").agg(F.count("*").alias("n"), F.sum(F.col("ties") * F.col("ties") - 1).alias("t"))
    a, b = (means.select("feature", F.col("g").alias(x), F.col("mean").alias(f"mean_{x}"), F.col("m").alias(f"m_{x}")) for x in "ab")
    both = a.join(b, "feature").where("a < b").join(whole, "feature")
    n = F.col("n")
    variance = (n * (n + 1) / 12 - F.col("t") / (12 * (n - 1))) * (1 / F.col("m_a") + 1 / F.col("m_b"))
    both = both.select("feature", "a", "b", F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(variance)).alias("z"))
    # two-sided tail of the normal distribution is that of its square
    return bh_adjusted(both.withColumn("p", _chi2(F.col("z") * F.col("z"), F.lit(1)) / 2), "p", ["feature"])


def wilcoxon_pairs(values: DataFrame, group: str = "outcome") -> DataFrame:
    """(feature, a, b, w, p, q): rank-sum tests of all pairs of groups, in place of Dunn's.

    By the normal distribution with correction for ties and continuity; two-sided, adjusted within each
    feature. A pair whose values are all equal has no p.
    """
    rows = values.where("x is not null").select("feature", F.col(group).alias("g"), "x")
    names = rows.select("feature", "g").distinct()
    pairs = names.withColumnRenamed("g", "a").join(names.withColumnRenamed("g", "b"), "feature").where("a < b")
    both = rows.join(pairs, "feature").where((F.col("g") == F.col("a")) | (F.col("g") == F.col("b")))
    pair = ["feature", "a", "b"]
    both = both.withColumn("r", average_rank(pair, "x")).withColumn("ties", F.count("*").over(Window.partitionBy(*pair, "x")))
    own = F.col("g") == F.col("a")
    tests = both.groupBy(*pair).agg(F.sum(F.when(own, F.col("r"))).alias("s"), F.count_if(own).alias("na"), F.count_if(~own).alias("nb"), F.sum(F.col("ties") * F.col("ties") - 1).alias("t"))
    na, nb, n = F.col("na"), F.col("nb"), F.col("na") + F.col("nb")
    w = F.col("s") - na * (na + 1) / 2
    away = w - na * nb / 2
    z = F.try_divide(away - F.signum(away) * 0.5, F.sqrt(na * nb / 12 * ((n + 1) - F.col("t") / (n * (n - 1)))))
    tests = tests.select(*pair, w.alias("w"), z.alias("z"))
    tests = tests.withColumn("p", F.when(F.col("z").isNotNull(), _chi2(F.col("z") * F.col("z"), F.lit(1)))).drop("z")
    return bh_adjusted(tests, "p", ["feature"])


def bootstrap_medians(values: DataFrame, group: list[str], rounds: int = 2000, level: float = 0.95, seed: int = 26) -> DataFrame:
    """(group, median, low, high) by resampling; fewer than three values give their median and no bounds.

    A resample's sorted places are those of sorted uniform numbers, so its middle places are drawn from
    the distributions of the middle order statistics alone: two numbers a round, however many values.
    """
    n = F.count("*").over(Window.partitionBy(*group))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("x"))
    known = values.where("x is not null and not isnan(x)").select(*group, "x", n.alias("n"), (place - 1).alias("at"))
    whole = known.groupBy(*group).agg(F.percentile("x", F.lit(0.5)).alias("own"), F.max("n").alias("n"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (n, key) in enumerate(zip(batch.column("n").to_pylist(), batch.column("key").to_pylist(), strict=True)):
                rng = np.random.default_rng((key % 2**64, seed))
                middle = (n + 1) // 2
                low = rng.beta(middle, n - middle + 1, rounds)
                high = low if n % 2 else low + (1 - low) * rng.beta(1, n - middle, rounds)
                at = np.minimum((np.concatenate([low, high]) * n).astype(np.int64), n - 1)
                names = [batch.column(g).take(pa.array(np.full(2 * rounds, i))) for g in group]
                yield pa.RecordBatch.from_arrays([*names, pa.array(np.tile(np.arange(rounds, dtype=np.int32), 2)), pa.array(at)], [*group, "round", "at"])

    kinds = ", ".join(f"`{g}` {whole.schema[g].dataType.simpleString()}" for g in group)
    draws = whole.where("n >= 3").select(*group, "n", F.xxhash64(*group).alias("key")).mapInArrow(draw, f"{kinds}, round int, at long")
    medians = draws.join(known, [*group, "at"]).groupBy(*group, "round").agg(F.avg("x").alias("m"))
    tail = (1 - level) / 2
    bounds = medians.groupBy(*group).agg(F.percentile("m", F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail))).alias("b"))
    return whole.join(bounds, group, "left").select(*group, F.coalesce(F.col("b")[1], "own").alias("median"), F.col("b")[0].alias("low"), F.col("b")[2].alias("high"))


def jaccard(sets: DataFrame, key: str, member: str) -> DataFrame:
    """(a, b, jaccard) for all pairs of sets given as rows (key, member). Sets are few; members are joined, not compared one by one."""
    rows = sets.select(key, member).distinct()
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
    common = rows.select(F.col(key).alias("a"), member).join(rows.select(F.col(key).alias("b"), member), member).where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    a, b = sizes.select(F.col(key).alias("a"), F.col("n").alias("na")), sizes.select(F.col(key).alias("b"), F.col("n").alias("nb"))
    both = a.join(b, F.col("a") < F.col("b")).join(common, ["a", "b"], "left")
    c = F.coalesce("c", F.lit(0))
    return both.select("a", "b", (c / (F.col("na") + F.col("nb") - c)).alias("jaccard"))


def selection_frequency(sets: DataFrame, key: str, member: str, least: int) -> DataFrame:
    """(member, folds, stable): in how many folds a feature was chosen."""
    return sets.groupBy(member).agg(F.count_distinct(key).cast("long").alias("folds")).withColumn("stable", F.col("folds") >= least)


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction; in logarithms, so that a and b may be large."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):  # the fraction converges fast on the other side
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total, m = d, 1
    while True:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d, c = 1 / (1 + term * d or tiny), 1 + term / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            return min(1.0, front * total)
        m += 1


def _root(f, low: float, high: float) -> float:
    """Where a rising function passes 0."""
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (low, middle) if f(middle) > 0 else (middle, high)
    return (low + high) / 2


def binomial_interval(hits: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact interval of a proportion, from quantiles of the beta distribution; of no trials the whole range."""
    tail = (1 - level) / 2
    low = 0.0 if hits == 0 else _root(lambda p: beta_cdf(p, hits, n - hits + 1) - tail, 0.0, 1.0)
    high = 1.0 if hits == n else _root(lambda p: beta_cdf(p, hits + 1, n - hits) - (1 - tail), 0.0, 1.0)
    return low, high


def t_quantile(p: float, df: int) -> float:
    """The value that a t distribution stays below with chance p, for p over a half."""
    return _root(lambda t: 1 - beta_cdf(df / (df + t * t), df / 2, 0.5) / 2 - p, 0.0, 1e9)


def mean_intervals(values: DataFrame, column: str, group: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """(group, n, mean, low, high): the t interval of a mean, as of accuracies over folds. One value gives no bounds."""
    found = values.where(F.col(column).isNotNull()).groupBy(*(group or [])).agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))

    @F.pandas_udf("double")
    def factor(n: pd.Series) -> pd.Series:
        known = {k: t_quantile(1 - (1 - level) / 2, int(k) - 1) if k > 1 else None for k in n.unique()}
        return n.map(known).astype("float64")

    half = factor("n") * F.col("sd") / F.sqrt("n")
    return found.select(*(group or []), "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def confusion(predictions: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return predictions.groupBy(actual, predicted).agg(F.count("*").alias("n"))


def agreement(matrix: DataFrame) -> DataFrame:
    """One row from a confusion matrix (actual, predicted, n): accuracy, kappa, macro precision, recall, F1, balanced accuracy.

    F1 of a class is missing if its precision and recall are both 0 or missing.
    """
    total = matrix.agg(F.sum("n").alias("total"))
    rows = matrix.groupBy(F.col("actual").alias("c")).agg(F.sum("n").alias("row"))
    cols = matrix.groupBy(F.col("predicted").alias("c")).agg(F.sum("n").alias("col"))
    hits = matrix.where("actual = predicted").groupBy(F.col("actual").alias("c")).agg(F.sum("n").alias("hit"))
    by_class = rows.join(cols, "c", "full").join(hits, "c", "left").fillna(0, ["row", "col", "hit"]).join(F.broadcast(total))
    precision, recall = F.try_divide("hit", "col"), F.try_divide("hit", "row")
    specificity = F.try_divide(F.col("total") - F.col("row") - F.col("col") + F.col("hit"), F.col("total") - F.col("row"))
    by_class = by_class.withColumns({"precision": precision, "recall": recall, "balanced": (recall + specificity) / 2})
    by_class = by_class.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
    out = by_class.agg(
        (F.sum("hit") / F.max("total")).alias("accuracy"), (F.sum(F.col("row") * F.col("col")) / (F.max("total") * F.max("total"))).alias("chance"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.avg("balanced").alias("balanced_accuracy"),
    )
    return out.select("accuracy", F.try_divide(F.col("accuracy") - F.col("chance"), 1 - F.col("chance")).alias("kappa"), "macro_precision", "macro_recall", "macro_f1", "balanced_accuracy")
