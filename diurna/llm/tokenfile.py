"""Token-id files with fixed-width bit packing.

Layout of one file, all numbers little-endian:

    ids      groups of 64 ids; a group is `bits` 64-bit words, id k of the group sits at bit k * bits
    blocks   for each block of BLOCK_IDS ids the byte where it begins (uint64)
    docs     for each document the number of ids before it in this file (uint64), and the total
    names    for each document its doc_id (int64; of the first `nulls` documents it is null)
    footer   MAGIC, bits, number of ids, of documents, of blocks, of nulls (uint64 each)

`bits` is the least that the largest id needs. A group has a whole number of words, so every block
can be found by its offset and unpacked alone with array operations; document d is ids[docs[d] :
docs[d + 1]] and touches only its blocks.

Files hold ranges of (doc_id, hash of the text), so a doc_id that is repeated often fills several of
them, and their number grows with the input. They are read back by as many tasks.

Defined cases: a null or empty text has no ids but the end id; equal doc_ids stand next to each other
in the order of their texts' hashes; a null doc_id comes first; very long texts are encoded whole;
extra columns are ignored; an empty table gives no file and no row.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import shared_folder, written
from .textcore import binary_array, flat, gather, pretokens, slices

MAGIC = 0x31535449424B4F54
BLOCK_IDS = 1 << 16
#: Bytes of text that are encoded at once.
SLICE_BYTES = 4 << 20
GROUP = 64
FOOTER_BYTES = 6 * 8
#: Bytes of text for each file, about; small tables have fewer in each.
FILE_BYTES = 256 << 20
#: Words whose ids a Python worker remembers between batches; when full it starts anew.
REMEMBERED = 500_000


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Whole groups of ids; the last group is filled with zeros."""
    full = np.zeros(-(-len(ids) // GROUP) * GROUP, np.uint64)
    full[: len(ids)] = ids
    groups = full.reshape(-1, GROUP)
    words = np.zeros((len(groups), bits), "<u8")
    for k in range(GROUP):
        word, shift = divmod(k * bits, 64)
        words[:, word] |= groups[:, k] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= groups[:, k] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack_ids(raw: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """`count` ids from number `first` of a buffer that begins at a group."""
    words = np.frombuffer(raw, "<u8").reshape(-1, bits)
    out = np.empty((len(words), GROUP), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for k in range(GROUP):
        word, shift = divmod(k * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, k] = x & mask
    return out.reshape(-1)[first : first + count]


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """A folder given as a path or a URI."""
    kind = urlparse(folder).scheme
    if kind in ("s3a", "s3n"):
        folder = f"s3{folder[len(kind):]}"
    if kind in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(folder).path if kind else folder
    return pafs.FileSystem.from_uri(folder)


def qualified(spark, folder: str) -> str:
    """The folder as a URI of the file system that Spark would write it to."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


class Writer:
    """Writes one file under a name of its own; whoever lists the file in a row publishes it."""

    def __init__(self, folder: str, name: str, bits: int) -> None:
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.name, self.bits = f"{folder}/{name}", bits
        self.out = self.fs.open_output_stream(f"{base}/{name}")
        self.rest = np.zeros(0, np.uint32)
        self.ids = 0
        self.lengths: list[np.ndarray] = []
        self.names: list[np.ndarray] = []
        self.nulls = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray, names: pa.Array) -> None:
        """Ids of the next documents, one after the other, how many each has, and their doc_ids (nulls first)."""
        self.lengths.append(lengths.astype(np.int64))
        self.nulls += names.null_count
        self.names.append(names.fill_null(0).to_numpy())
        self.ids += len(ids)
        ids = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(ids) // GROUP * GROUP
        self.out.write(pack_ids(ids[:whole], self.bits))
        self.rest = ids[whole:]

    def close(self) -> None:
        self.out.write(pack_ids(self.rest, self.bits))
        lengths = np.concatenate([np.zeros(1, np.int64), *self.lengths])
        starts = np.arange(0, self.ids, BLOCK_IDS, dtype=np.uint64) // np.uint64(GROUP) * np.uint64(self.bits * 8)
        self.out.write(starts.astype("<u8").tobytes())
        self.out.write(np.cumsum(lengths).astype("<u8").tobytes())
        self.out.write(np.concatenate([np.zeros(0, np.int64), *self.names]).astype("<i8").tobytes())
        self.out.write(np.array([MAGIC, self.bits, self.ids, len(lengths) - 1, len(starts), self.nulls], "<u8").tobytes())
        self.out.close()


class Reader:
    """Random access to the documents of a file."""

    def __init__(self, name: str) -> None:
        fs, path = filesystem(name)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, self.bits, self.ids, docs, n, nulls = np.frombuffer(self.file.read_at(FOOTER_BYTES, size - FOOTER_BYTES), "<u8").astype(np.int64).tolist()
        if magic != MAGIC:
            raise ValueError(f"{name} is not a token file")
        at = size - FOOTER_BYTES - 8 * docs
        self.names = pa.array(np.frombuffer(self.file.read_at(8 * docs, at), "<i8"), mask=np.arange(docs) < nulls)
        at -= 8 * (docs + 1)
        self.docs = np.frombuffer(self.file.read_at(8 * (docs + 1), at), "<u8").astype(np.int64)
        self.blocks = np.append(np.frombuffer(self.file.read_at(8 * n, at - 8 * n), "<u8").astype(np.int64), at - 8 * n)

    def read(self, first: int, upto: int) -> np.ndarray:
        """Ids number `first` to `upto`, from the blocks that hold them."""
        if upto <= first:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK_IDS, (upto - 1) // BLOCK_IDS + 1
        raw = self.file.read_at(int(self.blocks[b] - self.blocks[a]), int(self.blocks[a]))
        return unpack_ids(raw, self.bits, first - a * BLOCK_IDS, upto - first)

    def document(self, d: int) -> np.ndarray:
        return self.read(int(self.docs[d]), int(self.docs[d + 1]))

    def close(self) -> None:
        self.file.close()


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return own, [t.content for t in own.get_added_tokens_decoder().values()], Known(own)


class Known:
    """Ids of the words met so far, as flat arrays; each word is given to the library once."""

    def __init__(self, own) -> None:
        self.own = own
        # in a byte-level vocabulary each character of a token stands for one byte
        self.bytes_of = np.zeros(own.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in own.get_vocab(with_added_tokens=True).items():
            self.bytes_of[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.ids, self.ends = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and for each word where its ids begin and how many there are."""
        if len(self.at) > REMEMBERED:
            self.forget()
        at = self.at
        fresh = [w for w in words if w not in at]
        if fresh:
            at.update(zip(fresh, range(len(at), len(at) + len(fresh)), strict=True))
            # one call for all: each word is split and merged by itself
            ids = self.own.encode_batch_fast([[w.decode("utf-8", "replace") for w in fresh]], is_pretokenized=True, add_special_tokens=False)[0].ids
            ids = np.array(ids, np.uint32)
            upto = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)))) + 1
            self.ends.append(upto + self.ends[-1][-1])
            self.ids.append(ids)
        self.ids, self.ends = [np.concatenate(self.ids)], [np.concatenate(self.ends)]
        number = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
        ends = self.ends[0]
        return self.ids[0], ends[number], ends[number + 1] - ends[number]


def encode_slice(path: str, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents, each followed by `end`, and how many each has.

    The tokenizer's model works on the pieces of its pattern one by one, so each distinct piece is
    given to the library once. A text with one of its added tokens goes to the library whole.
    """
    own, special, known = tokenizer(path)
    data, offsets = flat(column)
    whole = np.zeros(len(offsets) - 1, bool)
    raw = data.tobytes()
    for mark in (s.encode() for s in special):
        at = raw.find(mark)
        while at >= 0:
            whole[np.searchsorted(offsets, at, side="right") - 1] = True
            at = raw.find(mark, at + 1)
    bounds, counts = pretokens(data, offsets)
    if whole.any():
        first = np.cumsum(counts) - counts
        drop = np.zeros(len(bounds), bool)
        for d in np.flatnonzero(whole):
            drop[first[d] + 1 : first[d] + counts[d]] = True
        bounds = bounds[~drop]
        counts = np.where(whole, 1, counts)
    pieces = binary_array(data, bounds).dictionary_encode()
    table, starts, lengths = known.look_up(pieces.dictionary.to_pylist())
    places = pieces.indices.to_numpy(zero_copy_only=False)
    sizes = lengths[places]
    by_piece = np.append(0, np.cumsum(sizes))
    per_doc = np.diff(by_piece[np.append(0, np.cumsum(counts))])
    out = np.full(int(per_doc.sum()) + len(per_doc), end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(per_doc + 1) - 1] = False
    out[keep] = table[gather(starts[places], sizes)]
    return out, per_doc + 1


def write(docs: DataFrame, path: str, end: int, folder: str) -> DataFrame:
    """Encodes docs(doc_id, text) and writes the files in ascending doc_id order.

    One row for each file: `part`, its place in the order, `file`, `ids` and `docs`, how many it holds.
    Documents are dealt by ranges of doc_id, so each task writes one stretch of the order.
    """
    own, _, _ = tokenizer(path)
    bits = max(own.get_vocab_size(with_added_tokens=True) - 1, end).bit_length()
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // FILE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        to = None
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                to = to or Writer(folder, f"{task.partitionId():06d}-{uuid.uuid4().hex}.ids", bits)
                to.add(*encode_slice(path, part.column("text"), end), part.column("doc_id"))
        if to:
            to.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([task.partitionId()], pa.int64()), pa.array([to.name]), pa.array([to.ids], pa.int64()), pa.array([sum(map(len, to.lengths))], pa.int64())],
                ["part", "file", "ids", "docs"],
            )

    dealt = docs.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return dealt.drop("tie").mapInArrow(run, "part long, file string, ids long, docs long")


def read(files: DataFrame) -> DataFrame:
    """Documents of the listed files, read back: doc_id, start (ids before it in all files), ids array<int>."""
    before = files.groupBy("part").agg(F.sum("ids").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    # one task for each file, whatever their number
    files = files.join(before, "part").repartition(max(files.count(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = Reader(row["file"])
                at = file.docs
                lo = 0
                while lo < len(at) - 1:
                    hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 20), side="right")) - 1)
                    values = file.read(int(at[lo]), int(at[hi]))
                    yield pa.RecordBatch.from_arrays(
                        [file.names.slice(lo, hi - lo), pa.array(row["before"] + at[lo:hi]), pa.ListArray.from_arrays(pa.array(at[lo : hi + 1] - at[lo], pa.int32()), pa.array(values.astype(np.int32)))],
                        ["doc_id", "start", "ids"],
                    )
                    lo = hi
                file.close()

    return files.mapInArrow(run, "doc_id long, start long, ids array<int>")


def summed(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends = np.append(0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)))
            raw = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_file(spark, sf_dir: str) -> DataFrame:
    """Every document of `documents`, encoded, written to packed files and read back from them."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write(docs, P.path("byte_bpe_50k.json"), 2, shared_folder(spark))
    return summed(read(written(files)))  # the list is kept, so that the files are written once
