"""Classifiers on one small matrix: a penalised multinomial model by paths, forests, and boosting of all classes at once.

All work on arrays. Trees of a forest, the classes of a boosting round and the penalties of a path
are computed side by side, as one more axis, so that no Python loop runs over rows, trees or features.
"""

from __future__ import annotations

import numpy as np

BINS = 32
#: Penalties of a path, least over greatest, and steps of the ascent.
PATH, RATIO, STEPS = 100, 0.01, 150


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def strongest(x: np.ndarray, y: np.ndarray, classes: int, weight: np.ndarray, alpha: float) -> float:
    """The least penalty of the path's first model, in which all coefficients are 0."""
    w = weight / weight.sum()
    shares = np.bincount(y, w, classes)
    residual = (np.eye(classes)[y] - shares) * w[:, None]
    return float(np.abs(_standard(x, w)[0].T @ residual).max() / max(alpha, 1e-3))


def _standard(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean = w @ x
    sd = np.sqrt(w @ (x - mean) ** 2)
    sd = np.where(sd > 0, sd, 1)
    return (x - mean) / sd, mean, sd


def net_path(x: np.ndarray, y: np.ndarray, classes: int, weight: np.ndarray, alpha: float, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts (penalty x class) and coefficients (penalty x feature x class) by accelerated proximal steps, all penalties at once.

    Minimises the weighted mean of the negative log-likelihood plus path * (alpha |b| + (1 - alpha) b^2 / 2).
    """
    w = weight / weight.sum()
    z, mean, sd = _standard(x, w)
    n, p = z.shape
    one = np.eye(classes)[y]
    step = 1 / (0.5 * np.linalg.eigvalsh((z * w[:, None]).T @ z).max() + 0.5 + (1 - alpha) * path.max())
    b, b0 = np.zeros((p, len(path), classes)), np.log(np.bincount(y, w, classes) + 1e-12) * np.ones((len(path), classes))
    ahead, ahead0, t = b, b0, 1.0
    ridge, lasso = ((1 - alpha) * path)[None, :, None], (alpha * path * step)[None, :, None]
    for _ in range(STEPS):
        odds = softmax((z @ ahead.reshape(p, -1)).reshape(n, len(path), classes) + ahead0)
        error = (odds - one[:, None, :]) * w[:, None, None]
        moved = ahead - step * ((z.T @ error.reshape(n, -1)).reshape(b.shape) + ridge * ahead)
        new, new0 = np.sign(moved) * np.maximum(np.abs(moved) - lasso, 0), ahead0 - step * error.sum(axis=0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead0 = new + (t - 1) / after * (new - b), new0 + (t - 1) / after * (new0 - b0)
        b, b0, t = new, new0, after
    b = (b / sd[:, None, None]).transpose(1, 0, 2)
    return b0 - np.einsum("p,lpk->lk", mean, b), b


def net_errors(x: np.ndarray, y: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Share of wrong predictions for each penalty."""
    odds = np.einsum("np,lpk->lnk", x, model[1]) + model[0][:, None, :]
    return (odds.argmax(axis=2) != y).mean(axis=1)


def fit_net(x: np.ndarray, y: np.ndarray, classes: int, weight: np.ndarray, alpha: float, folds: np.ndarray) -> dict:
    """The model of the penalty with the least mean error over folds (of equals the greatest penalty)."""
    path = np.geomspace(1, RATIO, PATH) * max(strongest(x, y, classes, weight, alpha), 1e-9)
    wrong = [net_errors(x[folds == f], y[folds == f], net_path(x[folds != f], y[folds != f], classes, weight[folds != f], alpha, path)) for f in np.unique(folds)]
    best = int(np.mean(wrong, axis=0).argmin())
    b0, b = net_path(x, y, classes, weight, alpha, path)
    return {"b0": b0[best], "b": b[best], "penalty": path[best]}


def predict_net(model: dict, x: np.ndarray) -> np.ndarray:
    return (x @ model["b"] + model["b0"]).argmax(axis=1)


def thresholds(x: np.ndarray) -> list[np.ndarray]:
    """For each feature at most BINS - 1 values between its distinct ones, at even ranks."""
    out = []
    for column in x.T:
        known = np.unique(column)
        middle = (known[1:] + known[:-1]) / 2
        out.append(middle[np.unique(np.linspace(0, len(middle) - 1, BINS - 1).round().astype(int))] if len(middle) >= BINS else middle)
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)], axis=1).astype(np.int64)


def grow(bins: np.ndarray, stats: np.ndarray, score, leaf, depth: int, rng: np.random.Generator, features: int | np.ndarray, least: float) -> dict:
    """Trees side by side from stats (tree x row x statistic): rows without any take no part.

    `score` values a node's summed statistics (a split is worth the gain of its halves), `leaf` gives
    its prediction, `features` is how many a node may try, or those that a tree may (tree x feature). Halves must sum up to `least` in their last statistic.
    """
    trees, n, m = stats.shape
    p = bins.shape[1]
    tree, row = np.nonzero(stats.any(axis=2))
    node = tree.copy()  # nodes of a level are numbered through all trees
    owner = np.arange(trees)
    levels, gains = [], np.zeros((trees, p))
    for level in range(depth + 1):
        g = len(owner)
        own = stats[tree, row]
        total = np.stack([np.bincount(node, own[:, k], g) for k in range(m)], axis=1)
        values = leaf(total)
        feature, cut, child = np.full(g, -1), np.zeros(g, np.int64), np.full(g, -1)
        if level < depth and len(node):
            # the features that each node may try
            choice = features[owner] if isinstance(features, np.ndarray) else rng.random((g, p)).argsort(axis=1)[:, :features]
            q = choice.shape[1]
            place = ((node[:, None] * q + np.arange(q)) * BINS + bins[row[:, None], choice[node]]).ravel()
            left = np.stack([np.bincount(place, np.repeat(own[:, k], q), g * q * BINS) for k in range(m)], axis=1).reshape(g, q, BINS, m).cumsum(axis=2)[:, :, :-1]
            right = total[:, None, None, :] - left
            gain = score(left) + score(right) - score(total)[:, None, None]
            gain[(left[..., -1] < least) | (right[..., -1] < least)] = -np.inf
            flat = gain.reshape(g, -1)
            best = flat.argmax(axis=1)
            worth = flat[np.arange(g), best]
            split = worth > 1e-9
            feature[split], cut[split] = choice[split, best[split] // (BINS - 1)], best[split] % (BINS - 1)
            np.add.at(gains, (owner[split], feature[split]), worth[split])
            child[split] = 2 * np.arange(split.sum())
        levels.append((feature, cut, child, values))
        if not (child >= 0).any():
            break
        inside = child[node] >= 0
        tree, row, node = tree[inside], row[inside], node[inside]
        node = child[node] + (bins[row, feature[node]] > cut[node])
        owner = np.repeat(owner[child >= 0], 2)
    return {"levels": levels, "trees": trees, "gains": gains}


def outputs(forest: dict, bins: np.ndarray) -> np.ndarray:
    """Predictions of each tree for each row: tree x row x value."""
    n = len(bins)
    node = np.repeat(np.arange(forest["trees"])[:, None], n, axis=1)
    out = np.zeros((forest["trees"], n, forest["levels"][0][3].shape[1]))
    active = np.ones(node.shape, bool)
    for feature, cut, child, values in forest["levels"]:
        ends = active & (child[node] < 0)
        out[ends] = values[node[ends]]
        active &= child[node] >= 0
        f = np.maximum(feature[node], 0)
        node = np.where(active, child[node] + (bins[np.arange(n)[None], f] > cut[node]), 0)
    return out


def fit_forest(x: np.ndarray, y: np.ndarray, classes: int, weight: np.ndarray, trees: int, tried: int, seed: int) -> dict:
    """Classification trees on bootstrap samples, grown to pure leaves, `tried` features at each node."""
    rng = np.random.default_rng(seed)
    cuts = thresholds(x)
    bins, parts = binned(x, cuts), []
    gini = lambda s: (s[..., :classes] ** 2).sum(axis=-1) / np.maximum(s[..., :classes].sum(axis=-1), 1e-12)
    leaf = lambda s: s[:, :classes] / np.maximum(s[:, :classes].sum(axis=1, keepdims=True), 1e-12)
    for at in range(0, trees, 50):
        drawn = rng.multinomial(len(x), np.full(len(x), 1 / len(x)), min(50, trees - at)).astype(float)
        stats = np.concatenate([drawn[:, :, None] * (weight[:, None] * np.eye(classes)[y]), drawn[:, :, None]], axis=2)
        parts.append(grow(bins, stats, gini, leaf, 24, rng, tried, 1))
    return {"cuts": cuts, "parts": parts, "gains": sum(f["gains"].sum(axis=0) for f in parts) / trees}


def forest_votes(model: dict, x: np.ndarray) -> np.ndarray:
    """The class that each tree votes for: tree x row."""
    bins = binned(x, model["cuts"])
    return np.concatenate([outputs(f, bins).argmax(axis=2) for f in model["parts"]])


def majority(votes: np.ndarray, classes: int) -> np.ndarray:
    return np.stack([(votes == k).sum(axis=0) for k in range(classes)], axis=1).argmax(axis=1)


def fit_boosting(x: np.ndarray, y: np.ndarray, classes: int, weight: np.ndarray, rate: float, depth: int, rounds: int, sample: float, seed: int, watch: tuple[np.ndarray, np.ndarray] | None = None, patience: int = 50) -> dict:
    """One tree for each class and round on the gradient of the softmax loss.

    With `watch` rows the rounds end when their loss has not fallen for `patience` rounds; `best` is the
    number of rounds with the least loss. `sample` is the share of rows and of features of a tree.
    """
    rng = np.random.default_rng(seed)
    cuts = thresholds(x)
    bins, n, p = binned(x, cuts), len(x), x.shape[1]
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + 1)
    leaf = lambda s: -rate * s[:, :1] / (s[:, 1:] + 1)
    margin, one, rows, gains, losses = np.zeros((n, classes)), np.eye(classes)[y], [], np.zeros(p), []
    if watch is not None:
        seen, held, wx = watch[1], np.zeros((len(watch[1]), classes)), binned(watch[0], cuts)
    for _ in range(rounds):
        odds = softmax(margin)
        g, h = (odds - one) * weight[:, None], np.maximum(2 * odds * (1 - odds) * weight[:, None], 1e-16)
        if sample < 1:
            drawn = rng.random(n) < sample
            g, h = g * drawn[:, None], h * drawn[:, None]
        some = np.sort(rng.permutation(p)[: max(1, round(sample * p))])
        trees = grow(bins, np.stack([g.T, h.T], axis=2), score, leaf, depth, rng, np.repeat(some[None], classes, axis=0), 1.0)
        rows.append(trees)
        gains += trees["gains"].sum(axis=0)
        margin += outputs(trees, bins)[:, :, 0].T
        if watch is not None:
            held += outputs(trees, wx)[:, :, 0].T
            losses.append(-np.log(np.maximum(softmax(held)[np.arange(len(seen)), seen], 1e-15)).mean())
            if len(losses) - 1 - int(np.argmin(losses)) >= patience:
                break
    best = int(np.argmin(losses)) + 1 if watch is not None else rounds
    return {"cuts": cuts, "rounds": rows, "best": best, "losses": losses, "gains": gains, "classes": classes}


def predict_boosting(model: dict, x: np.ndarray, rounds: int | None = None) -> np.ndarray:
    bins = binned(x, model["cuts"])
    return sum((outputs(t, bins)[:, :, 0].T for t in model["rounds"][: rounds or model["best"]]), np.zeros((len(x), model["classes"]))).argmax(axis=1)
