"""Learners against their definitions, and nested cross-validation over grids."""

import itertools

import numpy as np
import pytest

from diurna.operators import grids, learners
from tests.test_features import matrix


def rows(n=120, p=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    return x, (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int) + (x[:, 1] > 0.8), rng.random(n) + 0.5


def test_penalised_model_is_at_its_optimum():
    x, y, w = rows()
    x = (x - w @ x / w.sum()) / np.sqrt(w @ (x - w @ x / w.sum()) ** 2 / w.sum())
    for alpha in (0.1, 1.0):
        most = learners.strongest(x, y, 3, w, alpha)
        path = most * np.array([1.001, 0.5, 0.1])
        b0, b = learners.net_path(x, y, 3, w, alpha, path)
        assert np.abs(b[0]).max() < 1e-9 and (np.abs(b[2]) > 0).sum() > (np.abs(b[1]) > 0).sum() > 0
        for k, penalty in enumerate(path):
            odds = learners.softmax(x @ b[k] + b0[k])
            pull = x.T @ ((np.eye(3)[y] - odds) * (w / w.sum())[:, None]) - (1 - alpha) * penalty * b[k]
            on = np.abs(b[k]) > 1e-9  # at the optimum the pull is the penalty where a coefficient is not 0, and no more elsewhere
            assert np.allclose(pull[on], alpha * penalty * np.sign(b[k][on]), atol=2e-3) and (np.abs(pull[~on]) <= alpha * penalty + 2e-3).all()


def test_penalty_is_that_of_the_least_error():
    x, y, w = rows(200)
    folds = np.arange(200) % 5
    model = learners.fit_net(x, y, 3, w, 0.5, folds)
    path = learners.strongest(x, y, 3, w, 0.5) * np.geomspace(1, learners.RATIO, learners.PATH)
    wrong = [[(learners.predict_net({"b0": m[0][k], "b": m[1][k]}, x[folds == f]) != y[folds == f]).mean() for k in range(len(path))] for f in range(5) for m in [learners.net_path(x[folds != f], y[folds != f], 3, w[folds != f], 0.5, path)]]
    assert np.isclose(model["penalty"], path[np.mean(wrong, axis=0).argmin()]) and min(np.mean(wrong, axis=0)) < 0.35


def test_trees_take_the_best_split():
    x, y, w = rows(40, 3, 1)
    cuts = learners.thresholds(x)
    stats = np.concatenate([w[:, None] * np.eye(3)[y], np.ones((40, 1))], axis=1)[None]
    gini = lambda s: (s[..., :3] ** 2).sum(axis=-1) / np.maximum(s[..., :3].sum(axis=-1), 1e-12)
    tree = learners.grow(learners.binned(x, cuts), stats, gini, lambda s: s, 1, np.random.default_rng(0), 3, 1)
    feature, cut, child, _ = tree["levels"][0]

    def gain(f, c):
        left = x[:, f] <= c
        return sum(gini(stats[0][side].sum(axis=0)) for side in (left, ~left)) - gini(stats[0].sum(axis=0))

    best = max(gain(f, c) for f in range(3) for c in cuts[f])
    assert np.isclose(gain(feature[0], cuts[feature[0]][cut[0]]), best) and np.isclose(tree["gains"].sum(), best) and child[0] == 0
    out = learners.outputs(tree, learners.binned(x, cuts))[0]
    left = x[:, feature[0]] <= cuts[feature[0]][cut[0]]
    assert np.allclose(out[left], stats[0][left].sum(axis=0)) and np.allclose(out[~left], stats[0][~left].sum(axis=0))


def test_forest_is_pure_on_what_it_saw_and_repeats():
    x, y, w = rows(100)
    a, b = (learners.fit_forest(x, y, 3, w, 120, 2, 7) for _ in range(2))
    votes = learners.forest_votes(a, x)
    assert votes.shape == (120, 100) and (learners.majority(votes, 3) == y).all() and (votes == learners.forest_votes(b, x)).all()
    assert set(np.argsort(-a["gains"])[:2]) == {0, 1}
    assert (learners.forest_votes(learners.fit_forest(x[:, :1] * 0, y, 3, w, 5, 1, 1), x[:, :1]) >= 0).all()  # nothing to split


def test_boosting_follows_the_gradient_and_stops():
    x, y, w = rows(150)
    one = learners.fit_boosting(x, y, 3, w, 0.1, 1, 1, 1.0, 1)
    margin = learners.outputs(one["rounds"][0], learners.binned(x, one["cuts"]))[:, :, 0].T
    feature, cut, _, _ = one["rounds"][0]["levels"][0]
    left = x[:, feature[0]] <= one["cuts"][feature[0]][cut[0]]
    g, h = (1 / 3 - (y == 0)) * w, 2 * (1 / 3) * (2 / 3) * w
    assert np.allclose(margin[left, 0], -0.1 * g[left].sum() / (h[left].sum() + 1))
    fit = learners.fit_boosting(x[:100], y[:100], 3, w[:100], 0.3, 3, 400, 0.8, 1, (x[100:], y[100:]), 20)
    assert fit["best"] == int(np.argmin(fit["losses"])) + 1 and len(fit["rounds"]) == min(400, fit["best"] + 20)
    assert (learners.predict_boosting(fit, x[100:]) == y[100:]).mean() > 0.7


def test_ranks_weights_and_elbow(spark):
    from diurna.operators import screening

    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, 60).astype(float), rng.integers(0, 3, 60)
    v = spark.createDataFrame([("f", str(c), a) for a, c in zip(x.tolist(), y.tolist(), strict=True)], "feature string, outcome string, x double")
    assert np.isclose(grids.kruskal(x, y), screening.kruskal(v).first().h) and np.isnan(grids.kruskal(x * 0, y))
    w = grids.weights(np.array([0, 0, 0, 2]), 3)
    assert np.allclose(w, [0.5, 0.5, 0.5, 1.5])
    gains = np.array([0.0, 50, 30, 5, 15, *([0.0] * 10)])
    assert grids.elbow(gains)[:4].tolist() == [1, 2, 4, 3] and len(grids.elbow(gains)) == grids.LEAST and len(grids.elbow(np.ones(40))) == 36


def test_settings_are_the_whole_grid():
    assert len(grids.settings("elastic net", 100)) == 18 and len(grids.settings("elastic net", 21)) == 3
    assert len(grids.settings("forest", 200)) == 16 and len(grids.settings("pruned forest", 200)) == 32 and len(grids.settings("boosting", 45)) == 18
    assert [s["top"] for s in grids.settings("elastic net", 45)][::3] == [30, 40, 45]


@pytest.mark.parametrize("family", list(grids.GRIDS))
def test_nested_cross_validation(spark, monkeypatch, family):
    small = {"top": (2, 3), "alpha": (0.5,), "split": ("sqrt",), "trees": (5, 20), "rate": (0.3,), "depth": (2,), "rounds": (5, 20)}
    monkeypatch.setitem(grids.GRIDS, family, {k: small[k] for k in grids.GRIDS[family]})
    monkeypatch.setattr(grids, "LEAST", 1)
    m = matrix(spark, 60)
    out = grids.tuned(m, ["a", "b", "c"], family, outer=3, inner=2).collect()
    actual = {r.participantid: r.outcome for r in m.collect()}
    assert len(out) == 60 and all(actual[r.participantid] == r.actual for r in out)
    assert np.mean([r.actual == r.predicted for r in out]) > 0.75
    sizes = [sum(r.fold == f for r in out) for f in range(3)]
    assert max(sizes) - min(sizes) <= 4


def test_folds_see_training_rows_alone(spark):
    m = grids.matrix_of(matrix(spark, 60), ["a", "b", "c"], 3)
    train, test = np.flatnonzero(m.fold != 0), np.flatnonzero(m.fold == 0)
    a, _, columns = grids.prepared(m, train, test)
    m.x[test] *= 1000
    b, far, same = grids.prepared(m, train, test)
    assert (a == b).all() and (columns == same).all() and np.abs(far).max() == 3
    part = grids.inner_folds(m, train, 3)
    assert (part[test] == -1).all()
    cells = list(itertools.product(range(2), range(2)))
    assert all(max(n) - min(n) <= 1 for n in [[((part == f) & (m.y == c) & (m.device == d)).sum() for f in range(3)] for c, d in cells])
    with pytest.raises(ValueError):
        grids.matrix_of(matrix(spark, 60), ["a"] * 200_000, 3)
