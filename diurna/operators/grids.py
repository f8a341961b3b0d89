"""Nested cross-validation over grids of settings: one task fits one setting on one fold.

The participants' matrix has one row for each participant. It is copied to every task if it is counted
to be small (LIMIT), so the fits, which are many, run side by side. Larger matrices go through
`modelling.cross_validated`, where the rows of each fit are distributed instead.

Of each outer fold the training rows alone give scores by device, medians, class weights, the order of
features and, by inner folds, the setting; that is fitted on all of them and predicts the fold.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learners
from .modelling import folds, huber

#: Bytes of a matrix that is copied to all tasks.
LIMIT = 64 << 20
TOP = (30, 40, 50, 60, 70, 80)
#: Settings of the families: features taken (by Kruskal-Wallis), and what each model has beside.
GRIDS = {
    "elastic net": {"top": TOP, "alpha": (0.1, 0.5, 1.0)},
    "forest": {"top": (*TOP, 100, 120), "split": ("sqrt", "third"), "trees": (500, 1000)},
    "pruned forest": {"top": (*TOP, 100, 120), "split": ("sqrt", "third"), "trees": (500, 1000)},
    "boosting": {"top": TOP, "rate": (0.05, 0.1), "depth": (3, 5, 7), "rounds": (200, 500)},
    "pruned boosting": {"top": TOP, "rate": (0.05, 0.1), "depth": (3, 5, 7), "rounds": (200, 500)},
}
#: Settings of which one fit gives all values: of more trees the first are a smaller forest, and so are rounds.
NESTED = {"forest": "trees", "boosting": "rounds"}
SHARE, LEAST = 0.9, 10


@dataclass
class Matrix:
    keys: np.ndarray
    x: np.ndarray
    y: np.ndarray
    labels: list[str]
    device: np.ndarray
    fold: np.ndarray


def matrix_of(df: DataFrame, columns: list[str], k: int, label: str = "outcome", by: str = "device_type", key: str = "participantid") -> Matrix:
    """The rows of df with their outer folds, in the order of their keys."""
    known = df.where(F.col(label).isNotNull() & F.col(by).isNotNull())
    n = known.count()
    if n * (len(columns) + 8) * 8 > LIMIT:
        raise ValueError(f"{n} rows are too many to be copied; use modelling.cross_validated")
    rows = folds(known, [label, by], k, key, seed=1).select(F.col(key).cast("string").alias("_key"), F.col(label).cast("string").alias("_label"), F.col(by).cast("string").alias("_by"), "fold", *(F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(columns)))
    table = rows.orderBy("_key").toPandas()
    labels, y = np.unique(table["_label"].to_numpy(str), return_inverse=True)
    return Matrix(table["_key"].to_numpy(str), table[[f"_{i}" for i in range(len(columns))]].to_numpy(float), y, labels.tolist(), np.unique(table["_by"].to_numpy(str), return_inverse=True)[1], table["fold"].to_numpy(int))


def inner_folds(m: Matrix, rows: np.ndarray, k: int) -> np.ndarray:
    """Folds within rows, dealt evenly within each class and device; -1 outside."""
    out = np.full(len(m.y), -1)
    draw = np.random.default_rng(len(rows)).permutation(len(rows))
    order = rows[draw][np.lexsort((m.device[rows[draw]], m.y[rows[draw]]))]
    cell = m.y[order] * (m.device.max() + 1) + m.device[order]
    out[order] = (np.arange(len(order)) - np.searchsorted(cell, cell)) % k
    return out


def prepared(m: Matrix, train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores by device, cut at three, with medians for what is missing: training rows, test rows, and their columns in falling order of H."""
    x, good = np.full(m.x.shape, np.nan), np.ones(m.x.shape[1], bool)
    for d in np.unique(m.device[train]):
        mine, all_ = train[m.device[train] == d], m.device == d
        for c in range(m.x.shape[1]):
            mu, s = huber(m.x[mine, c])
            good[c] &= np.isfinite(s)
            x[all_, c] = np.clip((m.x[all_, c] - mu) / s, -3, 3) if np.isfinite(s) else np.nan
    x = x[:, good]
    middle = np.array([np.median(v[np.isfinite(v)]) if np.isfinite(v).any() else 0.0 for v in x[train].T])
    x = np.where(np.isfinite(x), x, middle)
    h = np.array([kruskal(v, m.y[train]) for v in x[train].T])
    order = np.argsort(-np.where(np.isfinite(h), h, -np.inf), kind="stable")[: int(np.isfinite(h).sum())]
    return x[train][:, order], x[test][:, order], np.flatnonzero(good)[order]


def kruskal(x: np.ndarray, y: np.ndarray) -> float:
    """Kruskal-Wallis H with correction for ties; not a number if all values are equal."""
    _, at, counts = np.unique(x, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[at]
    n, m = len(x), np.bincount(y)
    sums = np.bincount(y, rank)[m > 0]
    even = 1 - (counts.astype(float) ** 3 - counts).sum() / (float(n) ** 3 - n)
    return float((12 / (n * (n + 1)) * (sums**2 / m[m > 0]).sum() - 3 * (n + 1)) / even) if even > 0 else float("nan")


def weights(y: np.ndarray, classes: int) -> np.ndarray:
    """Inverse frequencies with mean 1 over the classes that occur."""
    counts = np.bincount(y, minlength=classes)
    per = np.where(counts > 0, 1 / np.maximum(counts, 1), 0)
    return (per / per[counts > 0].mean())[y]


def elbow(gains: np.ndarray) -> np.ndarray:
    """Features by falling gain up to the first whose running share reaches SHARE, LEAST of them at least."""
    order = np.argsort(-gains, kind="stable")
    share = np.cumsum(gains[order]) / max(gains.sum(), 1e-300)
    return order[: max(LEAST, int(np.searchsorted(share, SHARE - 1e-12)) + 1)]


def settings(family: str, p: int) -> list[dict]:
    """The settings that are fitted, without those that take the same features or that another fit contains."""
    grid = dict(GRIDS[family])
    if family in NESTED:
        grid[NESTED[family]] = (max(grid[NESTED[family]]),)
    grid["top"] = sorted({min(t, p) for t in grid["top"]})
    return [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]


class Fit:
    """One model of a family on prepared rows."""

    def __init__(self, family: str, s: dict, x: np.ndarray, y: np.ndarray, classes: int, watch: tuple[np.ndarray, np.ndarray] | None = None, chosen: np.ndarray | None = None, rounds: int | None = None) -> None:
        self.family, self.s, self.classes = family, s, classes
        w, x = weights(y, classes), x[:, : s["top"]]
        self.columns = np.arange(x.shape[1])
        watch = (watch[0][:, : s["top"]], watch[1]) if watch else None
        first = None
        if family.startswith("pruned") and chosen is None:
            first = self.one(x, y, w, watch, rounds)
            chosen = elbow(first["gains"])
        self.gains = np.zeros(x.shape[1]) if first is None else first["gains"]
        if chosen is not None:
            self.columns = chosen
            watch = (watch[0][:, chosen], watch[1]) if watch else None
        self.model = self.one(x[:, self.columns], y, w, watch, rounds)

    def one(self, x, y, w, watch, rounds):
        s, k = self.s, self.classes
        if self.family == "elastic net":
            return learners.fit_net(x, y, k, w, s["alpha"], np.random.default_rng(5).permutation(len(y)) % 10)
        if "forest" in self.family:
            tried = max(1, int(np.sqrt(x.shape[1]) if s["split"] == "sqrt" else x.shape[1] / 3))
            return learners.fit_forest(x, y, k, w, s["trees"], tried, 26)
        sample = 0.8 if self.family.startswith("pruned") else 1.0
        return learners.fit_boosting(x, y, k, w, s["rate"], s["depth"], rounds or s["rounds"], sample, 26, None if rounds else watch)

    def predictions(self, x: np.ndarray) -> list[tuple[dict, np.ndarray, int]]:
        """(setting, predicted, rounds) of this fit and of those that it contains."""
        x = x[:, : self.s["top"]][:, self.columns]
        if self.family == "elastic net":
            return [(self.s, learners.predict_net(self.model, x), 0)]
        if "forest" in self.family:
            votes = learners.forest_votes(self.model, x)
            sizes = GRIDS[self.family]["trees"] if self.family in NESTED else (self.s["trees"],)
            return [(self.s | {"trees": n}, learners.majority(votes[:n], self.classes), 0) for n in sizes]
        sizes = GRIDS[self.family]["rounds"] if self.family in NESTED else (self.s["rounds"],)
        ends = [int(np.argmin(self.model["losses"][:n])) + 1 if self.model["losses"] else self.model["best"] for n in sizes]
        return [(self.s | {"rounds": n}, learners.predict_boosting(self.model, x, end), end) for n, end in zip(sizes, ends, strict=True)]


def tuned(df: DataFrame, columns: list[str], family: str, outer: int = 10, inner: int = 3, label: str = "outcome", by: str = "device_type", key: str = "participantid") -> DataFrame:
    """(fold, participantid, actual, predicted, chosen): nested cross-validation of a family over its whole grid."""
    spark = df.sparkSession
    m = matrix_of(df, columns, outer, label, by, key)
    held = spark.sparkContext.broadcast(m)
    k = len(m.labels)
    jobs = [(o, i, json.dumps(s)) for s in settings(family, len(columns)) for o in np.unique(m.fold).tolist() for i in range(inner)]

    def error(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for frame in frames:
            for o, i, s in frame.itertuples(index=False):
                rows = np.flatnonzero(m.fold != o)
                part = inner_folds(m, rows, inner)
                train, test = rows[part[rows] != i], rows[part[rows] == i]
                if not len(test) or not len(train):
                    continue
                a, b, _ = prepared(m, train, test)
                if not a.shape[1]:
                    continue
                fit = Fit(family, json.loads(s), a, m.y[train], k, (b, m.y[test]))
                out = [(o, i, json.dumps(t), float((p != m.y[test]).mean()), end) for t, p, end in fit.predictions(b)]
                yield pd.DataFrame(out, columns=["fold", "part", "setting", "error", "rounds"])

    todo = spark.createDataFrame(jobs, "fold int, part int, setting string").repartition(len(jobs))
    # one row for each fit; of equal errors the first setting counts
    errors = todo.mapInPandas(error, "fold int, part int, setting string, error double, rounds int").groupBy("fold", "setting").agg(F.avg("error").alias("error"), F.avg("rounds").alias("rounds"))
    best = errors.groupBy("fold").agg(F.min(F.struct(F.round("error", 12).alias("error"), "setting", "rounds")).alias("b")).select("fold", "b.setting", "b.rounds")

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for frame in frames:
            for o, s, rounds in frame.itertuples(index=False):
                train, test = np.flatnonzero(m.fold != o), np.flatnonzero(m.fold == o)
                s, chosen = json.loads(s), None
                a, b, columns = prepared(m, train, test)
                if family.startswith("pruned"):  # the features with most mean gain over the inner folds, 0 where they were not taken
                    part, gains = inner_folds(m, train, inner), np.zeros(m.x.shape[1])
                    for i in range(inner):
                        rows, watched = train[part[train] != i], train[part[train] == i]
                        c, d, own = prepared(m, rows, watched)
                        gains[own[: s["top"]]] += Fit(family, s, c, m.y[rows], k, (d, m.y[watched])).gains
                    chosen = np.flatnonzero(np.isin(columns, elbow(gains)))
                fit = Fit(family, s | ({} if chosen is None else {"top": a.shape[1]}), a, m.y[train], k, None, chosen, max(1, round(rounds)) if "boosting" in family else None)
                found = fit.predictions(b)
                predicted = next((p for t, p, _ in found if t.get("trees") == s.get("trees")), found[0][1])
                yield pd.DataFrame({"fold": o, "participantid": m.keys[test], "actual": np.array(m.labels)[m.y[test]], "predicted": np.array(m.labels)[predicted], "chosen": json.dumps(s)})

    return best.repartition(len(np.unique(m.fold))).mapInPandas(predict, "fold int, participantid string, actual string, predicted string, chosen string")
