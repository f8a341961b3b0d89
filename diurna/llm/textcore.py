"""Vectorised text primitives on Arrow buffers.

A batch of documents is one byte buffer with document offsets. Everything here works on whole
buffers with numpy, so a batch costs a few array passes and no Python loop over characters or words.
"""

from __future__ import annotations

import ctypes
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step of work holds at once (a single longer document is one step).
SLICE_BYTES = 8 << 20
#: Bytes that a pass over single characters holds at once, as it needs many times that in arrays.
STEP_BYTES = 1 << 20
# freed buffers go back to the system, as many Python workers share an executor's memory
pa.set_memory_pool(pa.system_memory_pool())

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Code points with the White_Space property.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: idle workers share an executor's memory with busy ones."""
    _trim()(0)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `limit` bytes of text, or one row."""
    _, offsets = flat(batch.column(text))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        upto = min(max(upto, at + 1), batch.num_rows)
        yield batch.slice(at, upto - at)
        give_back()
        at = upto


def binary_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The stretches of data between successive bounds, without copying data."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)])


@functools.cache
def classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its class, and whether Unicode versions disagree about it."""
    now = np.full(0x110000, OTHER, np.uint8)
    unsure = np.zeros(0x110000, bool)
    kinds = {"L": LETTER, "N": NUMBER}
    for cp in range(0x110000):
        ch = chr(cp)
        a, b = unicodedata.category(ch)[0], unicodedata.ucd_3_2_0.category(ch)[0]
        if a in kinds:
            now[cp] = kinds[a]
        unsure[cp] = kinds.get(a) != kinds.get(b)
    now[list(WHITE)] = SPACE
    return now, unsure


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and the byte position of each, with the end."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    if len(begins) != len(points):
        raise ValueError("text is not UTF-8")
    return points, np.append(begins, len(data))


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the pieces of all documents and how many each has; works on STEP_BYTES at a time."""
    ends, counts, at, docs = [], [], 0, len(offsets) - 1
    while at < docs:
        upto = min(max(int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, side="right")) - 1, at + 1), docs)
        bounds, n = _pretokens(data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at])
        ends.append(bounds[:-1] + offsets[at])
        counts.append(n)
        at = upto
    ends.append(np.array([len(data)]))
    return np.concatenate(ends), np.concatenate(counts) if counts else np.zeros(0, np.int64)


def _pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of the GPT-2 style pattern begin, for all documents at once.

    The pattern is public_tokenizers.PATTERN: contractions, then runs of letters, numbers or other
    marks with one space before, then white space. Returns the byte bounds of the pieces (with the
    end) and, for each document, how many pieces it has. A document with a code point that Unicode
    versions class differently is one piece, for the tokenizer library to split by its own tables.
    """
    docs = len(offsets) - 1
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(docs, np.int64)
    points, begins = code_points(data)
    table, unsure = classes()
    kind = table[points]
    n = len(points)
    first = np.zeros(n + 1, bool)  # characters that begin a document
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    doc_at = np.searchsorted(begins, offsets[full])
    first[doc_at] = True
    first[n] = True
    space = kind == SPACE
    fresh = first[:n].copy()
    fresh[1:] |= kind[1:] != kind[:-1]
    blank = points == 32
    start = fresh.copy()
    # a run of other characters starts at the space before it
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1] & ~first[1:n]
    start &= space | ~after_blank | first[:n]
    # the last white space before a visible character stands alone or joins it
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    start |= last
    # contractions: a single apostrophe that starts a piece, with its letters
    q = np.flatnonzero((points == 39) & start & fresh)
    q = q[q + 1 < n]
    q = q[~first[q + 1] & (kind[q + 1] == LETTER)]
    if len(q):
        a = points[q + 1]
        b = np.where((q + 2 < n) & ~first[np.minimum(q + 2, n)], points[np.minimum(q + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        ends = np.concatenate([q[one] + 2, q[two] + 3])
        start[np.concatenate([q[one], q[two]]) + 1] = False
        ends = ends[ends < n]
        start[ends] = True
    odd = unsure[points]
    if odd.any():
        bad = np.unique(np.searchsorted(doc_at, np.flatnonzero(odd), side="right") - 1)
        limits = np.append(doc_at, n)
        for d in bad:
            start[limits[d] + 1 : limits[d + 1]] = False
    at = np.flatnonzero(start)
    counts = np.zeros(docs, np.int64)
    counts[full] = np.diff(np.append(np.searchsorted(at, doc_at), len(at)))
    return np.append(begins[at], len(data)), counts


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all stretches (start, length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
