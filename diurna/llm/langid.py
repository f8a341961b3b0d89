"""Language of mixed-language texts: script ranges, word scores, Viterbi with a switching penalty.

1. Words are runs of letters and marks with a letter among them, in lower case. The scripts of a word's letters (ranges of
   code points) narrow its candidates to the languages that were learned with those scripts.
2. A word scores, for each language, the sum of log-probabilities of its letter sequences of one to
   four characters, with word ends, from tables of hashed counts.
3. Viterbi over the words of a text finds the sequence of languages with the best total, where each
   change costs a penalty; its runs are spans of one language.
4. The text's language is the one whose spans hold most letters (ties: first in sorted order); the
   score is the share of the letters they hold, times how clearly the words of those spans prefer it.

The tables are fitted on at most TRAIN_DOCS doc_ids for each language, those with the smallest hashes,
with whole texts; every language is learned and every text is predicted whole. The tables of all
languages have at most CELLS cells together (but LEAST_BITS bits for each), so that many languages get
smaller tables, in which more letter sequences share a cell.

Defined cases: an empty table gives an empty result; a very long text is predicted whole, in one step; a null text and one without letters are `und` with score 0; words in a script that
no language was learned with score alike for all languages; without any learned language every text
is `und`; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import held_out
from .store import written
from .textcore import binary_array, code_points, flat, slices
from .words import small

#: Bounds of the sample that is learned from.
TRAIN_DOCS = 600
#: Bytes of text that are predicted at once.
SLICE_BYTES = 4 << 20
#: Bits of the hashed numbers of letter sequences, for few and for very many languages, and cells of all tables.
BITS, LEAST_BITS = 18, 10
CELLS = 1 << 23
ORDERS = (1, 2, 3, 4)
PENALTY = 6.0
#: A script is a candidate's own if at least this share of its letters are of that script.
SCRIPT_SHARE = 0.005

#: Beginnings of script ranges by code point; each reaches to the next. Fixed values from the Unicode block list.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
)
NAMES = sorted({name for _, name in SCRIPTS})


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether words hold it (2: it is a letter), and the number of its script."""
    word = np.array(["ML".find(unicodedata.category(chr(c))[0]) + 1 for c in range(0x110000)], np.uint8)
    begins = np.array([b for b, _ in SCRIPTS])
    numbers = np.array([NAMES.index(n) for _, n in SCRIPTS], np.uint8)
    return word, numbers[np.searchsorted(begins, np.arange(0x110000), side="right") - 1]


def words_in(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Words of all texts as numbers of distinct words, their lengths in characters, words by text."""
    lowered = pa.array([t.lower() if t else "" for t in column.to_pylist()], pa.large_string())
    data, offsets = flat(lowered)
    points, begins = code_points(data) if len(data) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
    kind = tables()[0][points]
    inside = kind > 0
    first = np.zeros(len(points) + 1, bool)
    first[np.searchsorted(begins, offsets)] = True
    begin, stop = inside.copy(), inside.copy()
    if len(points):
        begin[1:] &= ~inside[:-1] | first[1:-1]
        stop[:-1] &= ~inside[1:] | first[1:-1]
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    letters = np.append(0, np.cumsum(kind == 2))
    spoken = letters[b] > letters[a]  # marks alone are no word
    a, b = a[spoken], b[spoken]
    counts = np.diff(np.searchsorted(begins[a], offsets))
    # all stretches, words and what lies between, in turn; the words are every other one
    bounds = np.stack([begins[a], begins[b]], axis=1).ravel()
    parts = binary_array(data, bounds) if len(a) else pa.array([], pa.large_binary())
    words = parts.take(pa.array(np.arange(0, 2 * len(a), 2)[: len(a)])) if len(a) else parts
    return words.dictionary_encode(), b - a, counts


def bits_for(languages: int) -> int:
    """Bits of a number with which the tables of all languages have at most CELLS cells."""
    return max(LEAST_BITS, min(BITS, (CELLS // max(languages, 1)).bit_length() - 1))


def sequences(words: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the hashed letter sequences of words, how many each word has, scripts (bit mask) of each."""
    data, offsets = flat(words)
    n = len(words)
    text = np.full(len(data) + 2 * n, ord(" "), np.uint8)  # a space on either side
    keep = np.ones(len(text), bool)
    keep[offsets[:-1] + 2 * np.arange(n)] = False
    keep[offsets[1:] + 2 * np.arange(n) + 1] = False
    text[keep] = data
    points, begins = code_points(text) if n else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
    at = np.searchsorted(begins, np.append(offsets[:-1] + 2 * np.arange(n), len(text)))
    owner = np.repeat(np.arange(n), np.diff(at))
    masks = np.zeros(n, np.int64)
    if n:
        bit = np.where(points == 32, 0, np.int64(1) << tables()[1][points].astype(np.int64))
        masks = np.bitwise_or.reduceat(bit, at[:-1])
    out, who = [], []
    h = np.zeros(len(points), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        m = len(points) - order + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x100000001B3) + points[order - 1 :].astype(np.uint64) + np.uint64(order)
        ok = owner[:m] == owner[order - 1 :]
        if order == 1:
            ok &= points != 32
        mixed = h[ok] * np.uint64(0x9E3779B97F4A7C15)
        out.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
        who.append(owner[:m][ok])
    numbers, who = (np.concatenate(out), np.concatenate(who)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    by_word = np.argsort(who, kind="stable")
    return numbers[by_word], np.bincount(who, minlength=n), masks


class Model:
    """Tables of log-probabilities and the languages learned with each script."""

    def __init__(self, names: list[str], logs: np.ndarray, allowed: np.ndarray) -> None:
        self.names, self.logs, self.allowed = names, logs, allowed

    def word_scores(self, words: pa.Array) -> np.ndarray:
        """Words x languages; languages that the scripts rule out get a low score."""
        numbers, sizes, masks = sequences(words, len(self.logs).bit_length() - 1)
        scores = np.zeros((len(words), len(self.names)))
        full = np.flatnonzero(sizes)
        if len(full):
            scores[full] = np.add.reduceat(self.logs[numbers], (np.cumsum(sizes) - sizes)[full], axis=0)
        scores -= scores.max(axis=1, keepdims=True)
        # one very long word decides no more than a long word does
        scores = np.maximum(scores, -30.0)
        fits = np.ones(scores.shape, bool)
        for k in range(len(NAMES)):
            fits &= ((masks >> k) & 1 == 0)[:, None] | self.allowed[k][None]
        fits |= ~fits.any(axis=1, keepdims=True)
        return np.where(fits, scores, -30.0)


def viterbi(scores: np.ndarray, places: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word; step t is one operation on all texts with more than t words."""
    out = np.zeros(len(places), np.int32)
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    steps = int(counts.max()) if len(counts) else 0
    active = np.searchsorted(-counts[order], -np.arange(steps), side="left")
    if not steps:
        return out
    total = np.zeros((active[0], scores.shape[1]))
    stay = np.zeros((len(places), scores.shape[1]), bool)
    jump = np.zeros(len(places), np.int32)
    ended = np.zeros(active[0], np.int32)
    for t in range(steps):
        k = active[t]
        at = first[:k] + t
        now = total[:k]
        if t:
            best = now.argmax(axis=1)
            away = now[np.arange(k), best] - penalty
            keep = now >= away[:, None]
            stay[at], jump[at] = keep, best
            now = np.where(keep, now, away[:, None])
        now = now + scores[places[at]]
        total[:k] = now - now.max(axis=1, keepdims=True)
        over = active[t + 1] if t + 1 < steps else 0
        ended[over:k] = total[over:k].argmax(axis=1)
    state = np.zeros(active[0], np.int32)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        over = active[t + 1] if t + 1 < steps else 0
        state[over:k] = ended[over:k]
        at = first[:k] + t
        out[at] = state[:k]
        if t:
            kept = stay[at, state[:k]]
            state[:k] = np.where(kept, state[:k], jump[at])
    return out


def train(docs: DataFrame) -> Model | None:
    """Learns from documents with a language that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # those below a bound that about TRAIN_DOCS reach, so that no language is ranked whole
    counts = known.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n"))
    counts = written(counts)
    languages = counts.count()
    part = (1.25 * TRAIN_DOCS + 8 * TRAIN_DOCS**0.5 + 32) / F.col("n")
    near = known.select("doc_id", "lang").join(small(counts, languages), "lang").where(F.xxhash64("doc_id").cast("double") <= -(2.0**63) + part * 2.0**64)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = written(near.select("doc_id", "lang").distinct().withColumn("rank", rank).where(F.col("rank") <= TRAIN_DOCS).drop("rank"))
    names = sorted(r.lang for r in counts.select("lang").collect())
    if not names:
        return None
    number, bits = {name: i for i, name in enumerate(names)}, bits_for(len(names))
    table_size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                for lang in part.column("lang").unique().to_pylist():
                    own = part.filter(pa.compute.equal(part.column("lang"), lang))
                    words, _, _ = words_in(own.column("text"))
                    cells, sizes, masks = sequences(words.dictionary, bits)
                    weight = np.bincount(words.indices.to_numpy(zero_copy_only=False), minlength=len(words.dictionary))
                    table = np.bincount(cells, np.repeat(weight, sizes), table_size)
                    scripts = np.array([weight[(masks >> k) & 1 == 1].sum() for k in range(len(NAMES))], np.float64)
                    at = np.flatnonzero(table)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at) + len(scripts), number[lang], np.int32)), pa.array(np.append(at, table_size + np.arange(len(scripts))).astype(np.int32)), pa.array(np.append(table[at], scripts))],
                        ["lang", "cell", "n"],
                    )

    # at most TRAIN_DOCS rows of two short values for each language
    sample = known.select("doc_id", "lang", "text").join(small(chosen, chosen.count()), ["doc_id", "lang"], "left_semi")
    rows = sample.select("lang", "text").mapInArrow(run, "lang int, cell int, n double").groupBy("lang", "cell").agg(F.sum("n").cast("float").alias("n")).toArrow()
    counts = np.zeros((table_size + len(NAMES), len(names)), np.float32)
    counts[rows.column("cell").to_numpy(), rows.column("lang").to_numpy()] = rows.column("n").to_numpy()
    grams, scripts = counts[:table_size], counts[table_size:]
    logs = np.log(grams + np.float32(0.5)) - np.log(grams.sum(axis=0, dtype=np.float64) + 0.5 * table_size).astype(np.float32)
    logs -= logs.mean(axis=1, keepdims=True)
    return Model(names, logs, scripts >= SCRIPT_SHARE * scripts.sum(axis=0))


def _labelled(model: Model, column: pa.Array, penalty: float):
    words, lengths, counts = words_in(column)
    scores = model.word_scores(words.dictionary)
    places = words.indices.to_numpy(zero_copy_only=False)
    return viterbi(scores, places, counts, penalty), scores, places, lengths, counts


def predict(docs: DataFrame, model: Model | None, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                n = part.num_rows
                names, value = np.full(n, "und", object), np.zeros(n)
                if model is not None:
                    path, scores, places, lengths, counts = _labelled(model, part.column("text"), penalty)
                    doc = np.repeat(np.arange(n), counts)
                    m = len(model.names)
                    held = np.bincount(doc * m + path, lengths, n * m).reshape(n, m)
                    best = held.argmax(axis=1)
                    chance = np.exp(scores - scores.max(axis=1, keepdims=True))
                    chance = (chance / chance.sum(axis=1, keepdims=True))[places, path] if len(places) else np.zeros(0)
                    own = path == best[doc]
                    clear = np.bincount(doc[own], (lengths * chance)[own], n)
                    total = held.sum(axis=1)
                    some = total > 0
                    value[some] = clear[some] / total[some]
                    names[some] = np.array(model.names, object)[best[some]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(np.clip(value, 0, 1))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def spans(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, first_word, words, lang) for every run of one language in every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                path, _, _, _, counts = _labelled(model, part.column("text"), penalty)
                doc = np.repeat(np.arange(part.num_rows), counts)
                first = np.cumsum(counts) - counts
                cut = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (doc[1:] != doc[:-1]))) if len(path) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc[cut])), pa.array(cut - first[doc[cut]]), pa.array(np.diff(np.append(cut, len(path)))), pa.array(np.array(model.names, object)[path[cut]], pa.string())],
                    ["doc_id", "first_word", "words", "lang"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, first_word long, words long, lang string")


def op5_language(spark, sf_dir: str) -> DataFrame:
    """Language of every document of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
