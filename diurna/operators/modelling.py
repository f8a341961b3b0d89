"""Preparation, folds and classifiers on the participants' matrix with Spark ML."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .screening import agreement, confusion, kruskal

HUBER_K = 1.5


def huber(x: np.ndarray, k: float = HUBER_K, tol: float = 1e-6) -> tuple[float, float]:
    """Location and scale: Huber's estimate with the scaled median absolute deviation held fixed.

    Few values, or a deviation of 0, give the median and the deviation.
    """
    x = x[np.isfinite(x)]
    if not len(x):
        return float("nan"), float("nan")
    mid = float(np.median(x))
    mad = float(1.4826 * np.median(np.abs(x - mid)))
    if len(x) < 5 or mad == 0:
        return mid, mad + 1e-8
    while True:
        new = float(np.clip(x, mid - k * mad, mid + k * mad).mean())
        if abs(new - mid) < tol * mad:
            return new, mad
        mid = new


def fit_huber(train: DataFrame, columns: list[str], by: str = "device_type") -> DataFrame:
    """(by, feature, mu, s) for every group and column, each from its own values."""
    values = train.select(by, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns))).alias("p")).select(by, "p.feature", "p.x").where("x is not null")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        mu, s = huber(rows["x"].to_numpy())
        return pd.DataFrame({by: rows[by].iloc[:1], "feature": rows["feature"].iloc[:1], "mu": [mu], "s": [s]})

    return values.groupBy(by, "feature").applyInPandas(one, f"`{by}` {train.schema[by].dataType.simpleString()}, feature string, mu double, s double")


def winsorized(df: DataFrame, parameters: DataFrame, columns: list[str], by: str = "device_type", limit: float = 3.0) -> DataFrame:
    """Columns as scores of their group's location and scale, cut at the limit. Columns without parameters in a group become null."""
    wide = parameters.groupBy(by).pivot("feature", columns).agg(F.first("mu").alias("mu"), F.first("s").alias("s"))
    both = df.join(F.broadcast(wide), by, "left")  # one row for each group
    score = lambda c: F.greatest(F.lit(-limit), F.least(F.lit(limit), (F.col(f"`{c}`") - F.col(f"`{c}_mu`")) / F.col(f"`{c}_s`")))
    return both.withColumns({c: F.when(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}_s`").isNotNull(), score(c)) for c in columns}).select(df.columns)


def fit_medians(train: DataFrame, columns: list[str]) -> dict[str, float]:
    """Medians of the training rows; of a column without values 0."""
    row = train.agg(*(F.percentile(F.col(f"`{c}`"), F.lit(0.5)).alias(c) for c in columns)).first()
    return {c: float(row[c]) if row[c] is not None and np.isfinite(row[c]) else 0.0 for c in columns}


def imputed(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.fillna(medians)


def class_weights(train: DataFrame, label: str = "outcome", power: float = 1.0) -> DataFrame:
    """(label, n, weight): inverse frequencies to a power, with mean 1 over the classes."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    raw = F.pow(F.col("n").cast("double"), F.lit(-power))
    return counts.select(label, "n", (raw / F.avg(raw).over(Window.partitionBy())).alias("weight"))


def with_weights(train: DataFrame, label: str = "outcome", power: float = 1.0) -> DataFrame:
    return train.join(F.broadcast(class_weights(train, label, power).select(label, "weight")), label)


def upsampled(train: DataFrame, cell: list[str], key: str = "participantid", seed: int = 26) -> DataFrame:
    """Every cell drawn anew, with replacement, to the size of the largest; draws follow from hashes."""
    numbered = train.withColumn("_at", F.row_number().over(Window.partitionBy(*cell).orderBy(key)) - 1)
    sizes = train.groupBy(*cell).agg(F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n").alias("_most"))
    draws = sizes.join(F.broadcast(most)).withColumn("_draw", F.explode(F.sequence(F.lit(1), F.col("_most").cast("int"))))
    draws = draws.select(*cell, F.pmod(F.xxhash64(F.lit(seed), *cell, "_draw"), F.col("_n")).cast("int").alias("_at"))
    return draws.join(numbered, [*cell, "_at"]).select(train.columns)


def folds(df: DataFrame, strata: list[str], k: int, key: str = "participantid", seed: int | None = None) -> DataFrame:
    """Adds `fold`, 0 to k - 1, dealt evenly within each stratum, by a hash of the key (by the key itself without a seed)."""
    order = [F.xxhash64(F.lit(seed), key), F.col(key)] if seed is not None else [F.col(key)]
    return df.withColumn("fold", F.pmod(F.row_number().over(Window.partitionBy(*strata).orderBy(*order)) - 1, F.lit(k)).cast("int"))


def top_features(train: DataFrame, columns: list[str], n: int, label: str = "outcome") -> list[str]:
    """The n features that differ most between classes in the training rows."""
    values = train.select(label, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns))).alias("p")).select(label, "p.feature", "p.x")
    return [r.feature for r in kruskal(values, label).where("h is not null").orderBy(F.col("h").desc(), "feature").limit(n).collect()]


def elbow(importances: DataFrame, share: float = 0.9, least: int = 10) -> DataFrame:
    """Features, by falling importance, up to the first whose running share reaches `share`; at least `least`."""
    down = Window.orderBy(F.col("importance").desc(), "feature")
    total = F.sum("importance").over(Window.partitionBy())
    running = importances.withColumn("place", F.row_number().over(down)).withColumn("share", F.sum("importance").over(down.rowsBetween(Window.unboundedPreceding, 0)) / total)
    before = F.coalesce(F.lag("share").over(down), F.lit(0.0))
    return running.withColumn("_before", before).where((F.col("_before") < share) | (F.col("place") <= least)).drop("_before")


def average_importance(folds: DataFrame, n: int) -> DataFrame:
    """Mean importance over n folds; a feature missing in a fold counts 0 there."""
    return folds.groupBy("feature").agg((F.sum("importance") / n).alias("importance"))


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    columns: list[str]


def prepare(train: DataFrame, test: DataFrame, columns: list[str], by: str = "device_type") -> Prepared:
    """Scores by device and medians, both learned from the training rows alone; columns that fail are dropped."""
    parameters = fit_huber(train, columns, by)
    groups = train.select(by).distinct().count()
    good = {r.feature for r in parameters.where("s is not null and not isnan(s)").groupBy("feature").count().where(F.col("count") >= groups).collect()}
    columns = [c for c in columns if c in good]
    train, test = (winsorized(df, parameters, columns, by) for df in (train, test))
    medians = fit_medians(train, columns)
    return Prepared(imputed(train, medians), imputed(test, medians), columns)


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(df)


def indexed(train: DataFrame, label: str = "outcome"):
    """Turns class names into numbers; the indexer is fitted on the training rows."""
    return StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip").fit(train)


def elastic_net(alpha: float, strength: float, weighted: bool = True) -> LogisticRegression:
    return LogisticRegression(family="multinomial", elasticNetParam=alpha, regParam=strength, maxIter=100, **({"weightCol": "weight"} if weighted else {}))


def strengths(highest: float = 1.0, n: int = 100, ratio: float = 0.01) -> list[float]:
    """A path of penalties, evenly spaced in logarithms from the highest down."""
    return list(np.geomspace(highest, highest * ratio, n))


def random_forest(trees: int, per_split: str, weighted: bool = True, seed: int = 26) -> RandomForestClassifier:
    """per_split: "sqrt" or "onethird"."""
    return RandomForestClassifier(numTrees=trees, featureSubsetStrategy=per_split, maxDepth=10, seed=seed, **({"weightCol": "weight"} if weighted else {}))


def boosted(rate: float, depth: int, rounds: int, subsample: float = 0.8, seed: int = 26) -> OneVsRest:
    """Boosting of one class against the rest, in place of boosting all classes at once."""
    return OneVsRest(classifier=GBTClassifier(stepSize=rate, maxDepth=depth, maxIter=rounds, subsamplingRate=subsample, featureSubsetStrategy="0.8", seed=seed), weightCol="weight")


def importances(spark, model, columns: list[str]) -> DataFrame:
    """(feature, importance) of a forest, or the mean over the classes of a one-against-rest model."""
    models = getattr(model, "models", None) or [model]
    values = np.mean([m.featureImportances.toArray() for m in models], axis=0)
    return spark.createDataFrame([(c, float(v)) for c, v in zip(columns, values, strict=True)], "feature string, importance double")


def two_stage_forest(train: DataFrame, columns: list[str], forest: RandomForestClassifier, k: int = 3, share: float = 0.9, least: int = 10, label: str = "outcome", by: str = "device_type"):
    """(model, features): importances averaged over inner folds, their elbow, and a forest on those features alone."""
    spark = train.sparkSession
    index = indexed(train, label)
    rows = folds(index.transform(with_weights(train, label)), [label, by], k, seed=3).cache()
    kept = None
    for i in range(k):
        found = importances(spark, forest.fit(assembled(rows.where(F.col("fold") != i), columns)), columns)
        kept = found if kept is None else kept.unionByName(found)
    chosen = [r.feature for r in elbow(average_importance(kept, k), share, least).orderBy("place").collect()]
    return forest.fit(assembled(rows, chosen)), chosen


def best_strength(train: DataFrame, columns: list[str], alpha: float, path: list[float], k: int = 10, label: str = "outcome", by: str = "device_type") -> float:
    """The penalty of the path with the least mean error over folds of the training rows."""
    rows = folds(assembled(indexed(train, label).transform(with_weights(train, label)), columns), [label, by], k, seed=4).cache()
    error = lambda model, test: model.transform(test).agg(F.avg((F.col("label") != F.col("prediction")).cast("double"))).first()[0]
    mean = {s: np.mean([error(elastic_net(alpha, s).fit(rows.where(F.col("fold") != i)), rows.where(F.col("fold") == i)) or 0.0 for i in range(k)]) for s in path}
    return min(path, key=lambda s: mean[s])


def predicted(model, test: DataFrame, labels: list[str]) -> DataFrame:
    names = F.array(*map(F.lit, labels))
    return model.transform(test).select("*", F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"))


def cross_validated(df: DataFrame, columns: list[str], estimators: Iterable[tuple[str, object]], k: int = 10, inner: int = 3, top: Iterable[int] = (30,), label: str = "outcome", by: str = "device_type") -> DataFrame:
    """Nested cross-validation: (fold, participantid, actual, predicted, chosen).

    For each outer fold the setting with the least mean error over inner folds is fitted on all
    training rows. Scores, medians, weights and the choice of features see training rows only.
    """
    labelled = folds(df, [label, by], k, seed=1).cache()
    estimators, top, results = list(estimators), list(top), []

    def fitted(train: DataFrame, test: DataFrame, estimator, n: int) -> DataFrame:
        ready = prepare(train, test, columns, by)
        chosen = top_features(ready.train, ready.columns, n, label)
        index = indexed(ready.train, label)
        rows = assembled(index.transform(with_weights(ready.train, label)), chosen)
        return predicted(estimator.fit(rows), assembled(ready.test, chosen), index.labels)

    for fold in range(k):
        train, test = labelled.where(F.col("fold") != fold).drop("fold"), labelled.where(F.col("fold") == fold).drop("fold")
        settings = [(name, e, n) for name, e in estimators for n in top]
        if len(settings) > 1:
            parts = folds(train, [label, by], inner, seed=2)
            errors = []
            for name, e, n in settings:
                wrong = [fitted(parts.where(F.col("fold") != i).drop("fold"), parts.where(F.col("fold") == i).drop("fold"), e, n).agg(F.avg((F.col(label) != F.col("predicted")).cast("double"))).first()[0] for i in range(inner)]
                errors.append((float(np.mean(wrong)), name, n))
            best = min(range(len(settings)), key=lambda i: errors[i][0])
        else:
            best = 0
        name, estimator, n = settings[best]
        results.append(fitted(train, test, estimator, n).select(F.lit(fold).alias("fold"), "participantid", F.col(label).alias("actual"), "predicted", F.lit(f"{name}, {n}").alias("chosen")))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def evaluation(predictions: DataFrame) -> DataFrame:
    """Agreement over all folds together."""
    return agreement(confusion(predictions))
