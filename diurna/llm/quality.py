"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of its own and of the lines beside it. A two-state chain labels each line
good or bad; forward-backward gives the probability of good for every line, and the mean over lines
weighted by their lengths is the document's score.

Labels are known for documents only, so those of lines are latent: they are taught the chain's own
posterior, tilted by the least amount with which the mean over a document's lines, weighted by length,
agrees with its label by TAUGHT. A good line in a bad document can so stay good. Gradients of features
and of transitions are of one objective, in which documents count alike and labels as much as each other.

The chain is fitted on at most TRAIN_DOCS labelled documents of TRAIN_LINES lines together, those with
the smallest hashes of their doc_id (a sample independent of content and order), with whole texts;
scoring covers every line of every document.

Defined cases: an empty table gives an empty result; very long texts are scored whole; a null or empty text is one empty line; repeated rows get equal scores; a row whose
text repeats is scored as often as it occurs; extra columns are ignored; without any label of either
kind the score is 0.5. Of several labels for one document the smallest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .textcore import LETTER, NUMBER, SPACE, classes, code_points, flat, give_back, slices

#: Bound of the sample that the chain is fitted on.
TRAIN_DOCS, TRAIN_LINES = 2000, 1 << 19
#: Steps of the ascent; the first WARM teach all lines their document's label, then posteriors are taken anew every RETAUGHT.
ROUNDS, WARM, RETAUGHT = 150, 40, 20
#: How much of a document its lines' posteriors must make of its label.
TAUGHT = 0.95
#: Bytes of text whose lines are measured at once; the arrays for it take about forty times as much.
SLICE_BYTES = 1 << 20
#: From this score on a document counts as good.
GOOD = 0.7
OWN = 14


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all lines: features, lengths in characters; for all documents: number of lines."""
    docs = len(offsets) - 1
    # a line break ends each document, so that every document has a line
    text = np.full(len(data) + docs, 10, np.uint8)
    keep = np.ones(len(text), bool)
    keep[offsets[1:] + np.arange(docs)] = False
    text[keep] = data
    points, begins = code_points(text)
    n = len(points)
    ends = np.flatnonzero(points == 10)
    starts = np.append(0, ends[:-1] + 1)
    doc_ends = np.searchsorted(begins[:-1], offsets[1:] + np.arange(docs))
    lines = np.diff(np.append(0, np.searchsorted(ends, doc_ends, side="right")))
    kind = classes()[0][points]
    length = ends - starts

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask, dtype=np.int64))
        return (total[ends] - total[starts]).astype(np.float64)

    size = np.maximum(length, 1)
    space = kind == SPACE
    letter = kind == LETTER
    upper = np.zeros(n, bool)
    upper[letter] = _upper()[points[letter]]
    other = ~space & ~letter & (kind != NUMBER)
    word_begin = ~space & np.append(True, space[:-1])
    word_stop = ~space & np.append(space[1:], True)
    words = per_line(word_begin)
    many = np.maximum(words, 1)
    marks = np.isin(points, np.frombuffer("*$%&#!|~^=<>@_".encode("utf-32-le"), np.uint32))
    # equal neighbouring words, by a hash of their characters
    w0, w1 = np.flatnonzero(word_begin), np.flatnonzero(word_stop) + 1
    power = np.cumprod(np.full(256, np.uint64(0x9E3779B97F4A7C15)))
    if len(w0):
        within = np.arange(n) - np.repeat(np.append(0, w0), np.diff(np.append(np.append(0, w0), n)))
        terms = np.where(space, np.uint64(0), (points.astype(np.uint64) | np.uint64(32)) * power[within & 255])
        hashes = np.add.reduceat(terms, w0)
        again = np.zeros(n, bool)
        again[w0[1:]] = hashes[1:] == hashes[:-1]
    else:
        again = np.zeros(n, bool)
    again[starts] = False
    single = np.zeros(n, bool)
    single[w0[(w1 - w0) == 1]] = True
    ended_odd = np.zeros(n, bool)
    ended_odd[w1[marks[w1 - 1]] - 1] = True
    stops = np.isin(points, np.frombuffer(".,;:?".encode("utf-32-le"), np.uint32))
    full = length > 0
    own = np.stack(
        [
            np.log1p(length),
            per_line(upper) / size,
            per_line(letter) / size,
            per_line(kind == NUMBER) / size,
            per_line(other) / size,
            per_line(marks) / size,
            per_line(ended_odd) / many,
            per_line(again) / many,
            per_line(single) / many,
            per_line(stops) / many,
            (length - words) / many / 10,
            np.log1p(words),
            (per_line(again) / many > 0.3).astype(float),
            (~full).astype(float),
        ],
        axis=1,
    )
    return own, np.maximum(length, 1).astype(np.float64), lines


_UPPER: list[np.ndarray] = []


def _upper() -> np.ndarray:
    if not _UPPER:
        _UPPER.append(np.array([chr(c).isupper() for c in range(0x110000)]))
    return _UPPER[0]


def with_neighbours(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Features of each line, the line before and the line after in its document, and edges."""
    first = np.cumsum(lines) - lines
    last = first + lines - 1
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = own[first], own[last]
    edge = np.zeros((len(own), 2))
    edge[first, 0], edge[last, 1] = 1, 1
    return np.concatenate([own, before, after, edge], axis=1)


def chain(emit: np.ndarray, trans: np.ndarray, lines: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good for each line, and expected transitions (2 x 2), by forward-backward.

    With a weight for each line, transitions count by that of their first line.
    All chains step together, longest first, so that step t is one operation on those that reach it.
    """
    order = np.argsort(-lines, kind="stable")
    sizes = lines[order]
    first = (np.cumsum(lines) - lines)[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")
    fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
    for t in range(steps):
        at = first[: active[t]] + t
        if t:
            p = fwd[at - 1][:, :, None] + trans[None]
            top = p.max(axis=1)
            fwd[at] = emit[at] + top + np.log(np.exp(p - top[:, None, :]).sum(axis=1))
        else:
            fwd[at] = emit[at]
        fwd[at] -= fwd[at].max(axis=1, keepdims=True)
    moves = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        at = first[: active[t + 1]] + t
        p = trans[None] + (emit[at + 1] + bwd[at + 1])[:, None, :]
        top = p.max(axis=2)
        bwd[at] = top + np.log(np.exp(p - top[:, :, None]).sum(axis=2))
        bwd[at] -= bwd[at].max(axis=1, keepdims=True)
        pair = fwd[at][:, :, None] + p
        pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        moves += (pair if weight is None else pair * weight[at][:, None, None]).sum(axis=0)
    both = fwd + bwd
    both = np.exp(both - both.max(axis=1, keepdims=True))
    return both[:, 1] / both.sum(axis=1), moves


def taught(emit: np.ndarray, trans: np.ndarray, lines: np.ndarray, lengths: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the lines given their documents' labels, and their transitions; see the module."""
    first = np.cumsum(lines) - lines
    total = np.add.reduceat(lengths, first)
    side = np.where(label == 1, 1.0, -1.0)

    def tilted(tilt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = emit.copy()
        both[:, 1] += np.repeat(tilt * side, lines)
        return chain(both, trans, lines, weight)

    def agrees(good: np.ndarray) -> np.ndarray:
        share = np.add.reduceat(good * lengths, first) / total
        return np.where(label == 1, share, 1 - share) >= TAUGHT

    low, high = np.zeros(len(lines)), np.full(len(lines), 32.0)
    high[agrees(tilted(low)[0])] = 0.0
    for _ in range(10):
        middle = (low + high) / 2
        enough = agrees(tilted(middle)[0])
        low, high = np.where(enough, low, middle), np.where(enough, middle, high)
    return tilted(high)


def fit(own: np.ndarray, lengths: np.ndarray, lines: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Weights of the chain by gradient ascent, with latent labels of lines."""
    mean, sd = own.mean(axis=0), own.std(axis=0) + 1e-6
    x = with_neighbours((own - mean) / sd, lines)
    # each document counts alike, however many lines it has, and either label as much as the other
    share = np.where(label == 1, 0.5 / max((label == 1).sum(), 1), 0.5 / max((label == 0).sum(), 1))
    weight = np.repeat(share / lines, lines)
    w, trans = np.zeros((x.shape[1] + 1, 2)), np.zeros((2, 2))
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    y = np.repeat(label, lines).astype(np.float64)
    inside = np.ones(len(x), bool)
    inside[np.cumsum(lines) - lines] = False
    at = np.flatnonzero(inside)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), weight[at - 1])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros((2, 2)), np.zeros((2, 2))]
    for k in range(1, ROUNDS + 1):
        emit = x1 @ w
        if k > WARM and (k - WARM - 1) % RETAUGHT == 0:
            y, seen = taught(emit, trans, lines, lengths, label, weight)
        good, moves = chain(emit, trans, lines, weight)
        error = weight * (y - good)
        gw = np.stack([-(x1.T @ error), x1.T @ error], axis=1) - 1e-4 * w
        gt = seen - moves - 1e-4 * trans
        for i, (value, g) in enumerate(((w, gw), (trans, gt))):
            m, v = state[2 * i], state[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return {"mean": mean, "sd": sd, "w": w, "trans": trans}


def train(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray] | None:
    """Fits the chain on labelled documents that are not held out; None without both labels."""
    taught = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    taught = taught.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    taught = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                own, lengths, lines = line_features(*flat(part.column("text")))
                flat_own = pa.array(np.concatenate([own, lengths[:, None]], axis=1).astype(np.float32).ravel())
                ends = np.append(0, np.cumsum(lines)) * (OWN + 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), part.column("quality"), pa.array(lines), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat_own)], ["doc_id", "hash", "quality", "lines", "f"])

    # the sample has at most TRAIN_DOCS rows of two numbers, so it is broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(taught), "doc_id").select("doc_id", F.xxhash64("text").alias("hash"), "quality", "text")
    rows = written(texts.mapInArrow(run, "doc_id long, hash long, quality int, lines long, f array<float>"))
    # of repeated ids one text counts; documents that would exceed the bound of lines are left out
    sizes, fits, room = rows.groupBy("doc_id").agg(F.min(F.struct("hash", "lines")).alias("r")).orderBy(F.xxhash64("doc_id"), "doc_id").collect(), [], TRAIN_LINES
    for doc_id, (digest, lines) in sizes:
        if lines <= room:
            fits.append((doc_id, digest))
            room -= lines
    if not fits:
        return None
    fits = F.broadcast(docs.sparkSession.createDataFrame(fits, "doc_id long, hash long"))
    table = rows.join(fits, ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    quality = table.column("quality").to_numpy()
    if len(set(quality.tolist())) < 2:
        return None
    x = table.column("f").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, OWN + 1)
    model = fit(x[:, :OWN], x[:, OWN], table.column("lines").to_numpy(), quality)
    give_back()
    return model


def score(docs: DataFrame, model: dict[str, np.ndarray] | None, keep: bool = False) -> DataFrame:
    """Adds `score` (in place of a column of that name) to every row of docs; with `keep` all columns stay, else doc_id alone."""
    docs = docs.drop("score") if keep else docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                if model is None:
                    value = np.full(part.num_rows, 0.5)
                else:
                    own, lengths, lines = line_features(*flat(part.column("text")))
                    x = with_neighbours((own - model["mean"]) / model["sd"], lines)
                    good, _ = chain(x @ model["w"][:-1] + model["w"][-1], model["trans"], lines)
                    first = np.cumsum(lines) - lines
                    value = np.add.reduceat(good * lengths, first) / np.add.reduceat(lengths, first)
                columns = part.columns if keep else [part.column("doc_id")]
                names = part.schema.names if keep else ["doc_id"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.clip(value, 0, 1))], [*names, "score"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if keep or f.name == "doc_id"]
    return docs.mapInArrow(run, ", ".join([*kept, "score double"]))


def line_labels(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, line, good double) for every line: the probability that it is good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                own, _, lines = line_features(*flat(part.column("text")))
                x = with_neighbours((own - model["mean"]) / model["sd"], lines)
                good, _ = chain(x @ model["w"][:-1] + model["w"][-1], model["trans"], lines)
                number = np.arange(len(good)) - np.repeat(np.cumsum(lines) - lines, lines)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(np.repeat(np.arange(len(lines)), lines))), pa.array(number), pa.array(good)], ["doc_id", "line", "good"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, line long, good double")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document of `documents`, learned from `labels`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
