"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Every block of documents is cut into pieces with positions. The pieces of a block are a list of
   its distinct words and, for each position, the number of the word there.
2. The distinct words of all blocks are shuffled by word (packed: one row for all words of a block
   that fall into the same bucket). A task owns its words alone and encodes each once.
3. The ids go back to their blocks and the documents are reassembled by position.

Decoding joins the token-byte table: the vocabulary, of fixed size, is held by every worker as an array
of byte strings whose rows the ids select, so that ids are neither exploded nor shuffled.

A word frequent in the corpus costs one entry in each block, however often it occurs, so no key is
hot. Blocks are named by a digest of their content: if a lost executor makes Spark repeat a task,
its rows fit whichever of its attempts the others come from.

Defined cases: a null or empty text has no ids and decodes to no bytes; a very long text is a block of its own; repeated rows and null or
repeated doc_id values are encoded row by row; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import SLICE_BYTES, binary_array, flat, gather, give_back, pretokens, slices

#: Words whose ids a task remembers; when full it starts anew.
REMEMBERED = 1_000_000
#: Ids that are put in place and decoded at once (a single longer document is one step).
STEP_IDS = 1 << 18


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    """The byte strings of a rank file and their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@functools.cache
def token_bytes(path: str) -> pa.Array:
    """The token-byte table: row i holds the bytes of id i."""
    by_id = {i: b for b, i in ranks(path).items()}
    return pa.array([by_id.get(i, b"") for i in range(max(by_id) + 1)], pa.large_binary())


def bucket_of(words: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each word, from its bytes alone."""
    data, bounds = flat(words)
    sizes = np.diff(bounds)
    if not len(data):
        return np.zeros(len(words), np.int64)
    powers = np.full(1024, np.uint64(0x9E3779B97F4A7C15))
    powers = np.cumprod(powers)
    within = np.arange(len(data)) - np.repeat(bounds[:-1], sizes)
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers[within & 1023]
    h = np.add.reduceat(terms, np.minimum(bounds[:-1], len(data) - 1))
    h[sizes == 0] = 0
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return (h % np.uint64(buckets)).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed byte string: for each its length, then all contents."""
    head = np.array([a.nbytes for a in arrays], "<i8").tobytes()
    return zstandard.compress(head + b"".join(a.tobytes() for a in arrays), 3)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    sizes = np.frombuffer(raw, "<i8", len(kinds))
    at, out = 8 * len(kinds), []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.RecordBatch, pa.DictionaryArray, np.ndarray]]:
    """Blocks of documents: name, documents, pieces as numbers of distinct words, pieces by document."""
    for batch in batches:
        for part in slices(batch, "text", limit):
            data, offsets = flat(part.column("text"))
            bounds, counts = pretokens(data, offsets)
            pieces = binary_array(data, bounds).dictionary_encode()
            words, ends = flat(pieces.dictionary)
            digest = hashlib.blake2b(words.tobytes(), digest_size=8)
            digest.update(np.ascontiguousarray(ends).tobytes())
            yield int.from_bytes(digest.digest(), "little", signed=True), part, pieces, counts


def words_of(limit: int, buckets: int):
    """Documents to rows (bucket, block, places, words): the distinct words of a block by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, pieces, _ in blocks(batches, limit):
            words = pieces.dictionary
            if not len(words):
                continue
            bucket = bucket_of(words, buckets)
            order = np.argsort(bucket, kind="stable")
            data, ends = flat(words.take(pa.array(order)))
            cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            rows = []
            for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
                rows.append((int(bucket[order[a]]), block, pack(order[a:b].astype("<u4"), np.diff(ends[a : b + 1]).astype("<u4"), data[ends[a] : ends[b]])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "block", "words"])

    return run


def encoded(path: str, pattern: str):
    """Rows of words to rows of ids. All rows of a bucket are here, so each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path, pattern).encode_ordinary
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            blobs = []
            for blob in batch.column("words"):
                places, sizes, data = unpack(blob.as_py(), "<u4", "<u4", "u1")
                raw, at, out = data.tobytes(), 0, []
                for size in sizes.tolist():
                    word = raw[at : at + size]
                    at += size
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        ids = known[word] = encode(word.decode("utf-8", "replace"))
                    out.append(ids)
                lengths = np.fromiter(map(len, out), "<u4", len(out))
                blobs.append(pack(places, lengths, np.fromiter((i for ids in out for i in ids), "<u4", int(lengths.sum()))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(blobs, pa.binary())], ["block", "ids"])
        known.clear()
        give_back()

    return run


def positions_of(limit: int):
    """Documents to rows (block, documents, positions): for each position the number of its word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part, pieces, counts in blocks(batches, limit):
            places = pieces.indices.to_numpy(zero_copy_only=False).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([pack(counts.astype("<u4"), places, np.array([len(pieces.dictionary)], "<u4"))], pa.binary())],
                ["block", "doc_ids", "places"],
            )

    return run


def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, its ids before its documents: to (doc_id, ids)."""
    now, parts, table = None, [], None
    for batch in batches:
        for at in range(batch.num_rows):
            block, blob = batch.column("block")[at].as_py(), batch.column("ids")[at].as_py()
            if block != now:
                now, parts, table = block, [], None
            if blob is not None:
                parts.append(unpack(blob, "<u4", "<u4", "<u4"))
                table = None
                continue
            counts, places, size = unpack(batch.column("places")[at].as_py(), "<u4", "<u4", "<u4")
            if table is None:
                table = ids_of_words(parts, int(size[0]))
                parts = []  # no ids of a block come after its documents
            starts, lengths, ids = table
            doc_ids = batch.column("doc_ids")[at].values
            pieces = np.append(0, np.cumsum(counts, dtype=np.int64))
            lo = 0
            while lo < len(counts):  # some documents at a time, as the next steps hold many times their ids
                # no more pieces than ids are taken, as each has one at least
                hi = max(lo + 1, int(np.searchsorted(pieces, pieces[lo] + STEP_IDS, side="right")) - 1)
                sizes = lengths[places[pieces[lo] : pieces[hi]]]
                ends = np.append(0, np.cumsum(sizes))[pieces[lo : hi + 1] - pieces[lo]]
                hi = max(lo + 1, lo + int(np.searchsorted(ends, STEP_IDS, side="right")) - 1)
                ends, own = ends[: hi - lo + 1], slice(pieces[lo], pieces[hi])
                values = ids[gather(starts[places[own]], sizes[: own.stop - own.start])]
                yield pa.RecordBatch.from_arrays([doc_ids[lo:hi], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))], ["doc_id", "ids"])
                lo = hi
            give_back()


def ids_of_words(parts: list[list[np.ndarray]], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the ids of each word of a block begin, how many they are, and the ids."""
    lengths = np.zeros(words, np.int64)
    have = np.zeros(words, bool)
    for p, n, _ in parts:
        lengths[p], have[p] = n, True
    if not have.all():
        raise RuntimeError("words of a block are missing: the input changed between reads")
    starts = np.cumsum(lengths) - lengths
    ids = np.zeros(int(lengths.sum()), np.int32)
    for p, n, x in parts:
        ids[gather(starts[p], n.astype(np.int64))] = x
    return starts, lengths, ids


def parts_of(docs: DataFrame, path: str, pattern: str, limit: int) -> DataFrame:
    """The ids of all words and the positions of all documents, sorted by block for `assembled`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = (
        docs.mapInArrow(words_of(limit, buckets), "bucket int, block long, words binary")
        .repartition(buckets, "bucket")
        .mapInArrow(encoded(path, pattern), "block long, ids binary")
    )
    places = docs.mapInArrow(positions_of(limit), "block long, doc_ids array<long>, places binary")
    both = ids.unionByName(places, allowMissingColumns=True)
    return both.repartition(buckets, "block").sortWithinPartitions("block", F.col("ids").isNull())


def encode(docs: DataFrame, path: str, pattern: str, limit: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, ids array<int>) for every row of docs(doc_id, text)."""
    return parts_of(docs, path, pattern, limit).mapInArrow(assembled, "doc_id long, ids array<int>")


def decoded(path: str):
    """Rows with ids to the same rows with `bytes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            ids = batch.column("ids")
            if ids.null_count:
                ids = ids.fill_null([])
            values, ends = ids.flatten(), np.append(0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)))
            data, bounds = flat(table.take(values))
            yield pa.RecordBatch.from_arrays([*batch.columns, binary_array(data, bounds[ends]).cast(pa.binary())], [*batch.schema.names, "bytes"])

    return run


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Adds `bytes`, what the ids of each row stand for. An id outside the vocabulary is an error."""
    return tokens.mapInArrow(decoded(path), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in tokens.schema.fields)}, bytes binary")


def encode_and_decode(docs: DataFrame, path: str, pattern: str, limit: int = SLICE_BYTES) -> DataFrame:
    """`decode` of `encode`, with one Python worker for each task in place of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decoded(path)(assembled(batches))

    return parts_of(docs, path, pattern, limit).mapInArrow(run, "doc_id long, ids array<int>, bytes binary")


def digests(tokens: DataFrame) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids in decimal joined by commas, and of the decoded bytes."""
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document of `documents`, encoded and decoded by the multilingual ranks."""
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(encode_and_decode(docs, path, P.PATTERN))
