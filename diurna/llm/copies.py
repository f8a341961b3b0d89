"""Near copies by exact shingle similarity: candidates from SimHash links and MinHash bands, each verified.

1. Every text gets its SimHashes and BANDS keys, each of ROWS MinHashes over its shingles. Texts with
   equal words are one node. What SimHash links (`simhash.linked`) is one key more.
2. Nodes that share a key are candidates. Two texts at the similarity share no band with a chance of
   (1 - SIMILARITY ** ROWS) ** BANDS, about 7 in 10,000, and less above it.
3. In each key the node with most candidates is the centre and is compared with all that are not
   connected to it yet, by the Jaccard similarity of the sets of shingles. Then all that concerns the
   centre is decided and it leaves the key. A key whose nodes are all connected is done. In the first
   turn each node is compared in its largest key alone, which connects most of a group of near copies
   by one comparison a node, however many keys they share.
4. When what is left is little, or no longer falls, its pairs are compared in blocks: of each key, or of
   keys that share most nodes, all nodes outside the largest connected part against all nodes, about
   STRAYS by MEMBERS of them in a task.

No task holds a whole key or group, and no pair of a key is left out: it is compared, or both are
connected by others.

Defined cases: texts without words are copies of each other; a text shorter than a shingle is one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import SLICE_BYTES, columns_of, components, linked, mixed, shingle_hashes, votes
from .store import written
from .textcore import gather, slices
from .words import small

ROWS, BANDS = 6, 24
#: As a fraction, so that the test is exact.
SIMILARITY = (4, 5)
#: Pairs of one centre that a task compares; hashes of centres that are broadcast at most (32 MB).
PAIRS, BROADCAST_HASHES = 4096, 4 << 20
#: Nodes of a block; turns of centres at most; pairs for each node that are little enough to be compared in blocks.
STRAYS, MEMBERS, TURNS, LITTLE = 1024, 4096, 12, 16


def band_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each document BANDS keys; documents without shingles have zeros."""
    out = np.zeros((len(counts), BANDS), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    begins = (np.cumsum(counts) - counts)[full]
    draws = np.random.default_rng(11).integers(0, 2**64, (BANDS, ROWS, 2), dtype=np.uint64)
    for b in range(BANDS):
        key = np.full(len(full), b, np.uint64)
        for flip, times in draws[b]:
            least = np.minimum.reduceat((hashes ^ flip) * (times | np.uint64(1)), begins)
            key = mixed(key ^ least, 1)
        out[full, b] = key
    return out


def marked(docs: DataFrame, words: int, tables: int) -> DataFrame:
    """(doc_id, text_hash, node, fp ..., keys) for every row; rows with equal words have one node."""
    names = columns_of(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                hashes, counts, whole = shingle_hashes(part.column("text"), words)
                node = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in whole), np.uint64, len(counts))
                fps = [votes(mixed(hashes, t), counts) for t in range(tables)]
                keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(hashes, counts).reshape(-1).view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
                columns = [part.column("doc_id"), part.column("text_hash"), *(pa.array(x.view(np.int64)) for x in (node, *fps)), keys]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", *names, "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, node long, " + ", ".join(f"{n} long" for n in names) + ", keys array<long>")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles, n): the distinct shingle hashes of texts(node, text), one row for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                hashes, counts, _ = shingle_hashes(part.column("text"), words)
                sets = [np.unique(hashes[e - n : e]) for e, n in zip(np.cumsum(counts), counts, strict=True)]
                ends = np.append(0, np.cumsum([len(x) for x in sets]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), lists, pa.array(np.diff(ends), pa.int32())], ["node", "shingles", "n"])

    return texts.mapInArrow(run, "node long, shingles array<long>, n int").dropDuplicates(["node"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the pairs (node, centre) that reach the similarity. Centres with many pairs are spread over tasks."""
    over, under = SIMILARITY
    asked = pairs.groupBy("centre").agg(F.count("*").alias("pairs")).withColumn("salts", F.ceil(F.col("pairs") / PAIRS).cast("int"))
    centres = asked.join(sets, F.col("centre") == F.col("node")).select("centre", "salts", F.col("shingles").alias("theirs"), F.col("n").alias("m"))
    centres = written(centres)
    held = centres.agg(F.sum(F.col("m") + 8)).first()[0] or 0
    if held <= BROADCAST_HASHES:
        centres, on = F.broadcast(centres), ["centre"]
    else:
        busy = asked.where("salts > 1").select("centre", F.col("salts").alias("_salts"))  # at most one centre for each PAIRS pairs
        pairs = pairs.join(small(busy, busy.count()), "centre", "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.coalesce("_salts", F.lit(1))).cast("int"))
        centres, on = centres.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))), ["centre", "salt"]
    both = pairs.join(sets, "node").join(centres, on)
    size = F.col("n") + F.col("m")
    near = both.where(under * F.least("n", "m") >= over * F.greatest("n", "m"))
    common = F.size(F.array_intersect("shingles", "theirs"))
    return near.where(under * common >= over * (size - common)).select(F.col("node").alias("a"), F.col("centre").alias("b"))


def compared(table: pa.Table) -> pa.Table:
    """Links (a, b) of strays with members of a block; of links that others connect already none is given."""
    over, under = SIMILARITY
    stray = table.column("stray").to_numpy(zero_copy_only=False)
    node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
    members, strays = np.flatnonzero(~stray), np.flatnonzero(stray)
    nothing = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not len(members) or not len(strays):
        return nothing
    lists = table.column("shingles").combine_chunks()
    ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
    terms, flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    sizes = np.diff(ends)
    owner = np.repeat(np.arange(len(members)), sizes[members])
    theirs = flat[gather(ends[members], sizes[members])]
    _, root = np.unique(comp, return_inverse=True)
    held, a, b = np.zeros(len(terms), bool), [], []
    for x in strays:
        other = root[members] != root[x]
        if not other.any():
            continue
        mine = flat[ends[x] : ends[x + 1]]
        held[mine] = True
        both = np.bincount(owner[held[theirs]], minlength=len(members))
        held[mine] = False
        near = np.flatnonzero(other & (under * both >= over * (sizes[members] + sizes[x] - both)))
        for y in members[near]:
            if root[y] != root[x]:
                root[root == root[y]] = root[x]
                a.append(node[x])
                b.append(node[y])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def largest_part(rows: DataFrame, bucket: str) -> DataFrame:
    """(bucket, m, comps, big): number of nodes and of connected parts, and the largest part, of rows(bucket, node, comp)."""
    by_comp = rows.groupBy(bucket, "comp").agg(F.count("*").alias("n"))
    return by_comp.groupBy(bucket).agg(F.sum("n").alias("m"), F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("big"))


def rest_of(own: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links among what is left in the keys, own(key, node, comp), compared in blocks.

    Keys that share many nodes would compare them again and again: what a chain of keys connects is
    one bucket if it has fewer pairs than its keys have together; else each key is a bucket.
    """
    low = own.groupBy("key").agg(F.min("node").alias("low"))
    chained = written(components(own.join(low, "key").select(F.col("node").alias("a"), F.col("low").alias("b")))).withColumnRenamed("root", "part")
    rows = written(own.select("key", "node", "comp").join(chained, "node", "left").withColumn("part", F.coalesce("part", "node")))
    pairs = (F.col("m") - F.col("big.n")).cast("double") * F.col("m")
    by_key = largest_part(rows, "key").select("key", pairs.alias("pairs")).join(rows.select("key", "part").distinct(), "key").groupBy("part").agg(F.sum("pairs").alias("apart"))
    nodes = rows.select("part", "node", "comp").distinct()
    joint = largest_part(nodes, "part").select("part", pairs.alias("pairs")).join(by_key, "part").where("pairs <= apart").select("part", F.lit(True).alias("joint"))
    as_part = nodes.join(joint, "part").select(F.col("part").alias("bucket"), "node", "comp", F.lit(0).alias("kind"))
    as_key = rows.join(joint, "part", "left_anti").select(F.col("key").alias("bucket"), "node", "comp", F.lit(1).alias("kind"))
    left = written(as_part.unionByName(as_key).withColumn("bucket", F.xxhash64("bucket", "kind")).drop("kind"))
    many = largest_part(left, "bucket").where("comps > 1")
    many = many.select("bucket", F.col("big.comp").alias("most"), F.ceil((F.col("m") - F.col("big.n")) / STRAYS).cast("int").alias("i_n"), F.ceil(F.col("m") / MEMBERS).cast("int").alias("j_n"))
    rows = left.join(many, "bucket").withColumn("i", F.pmod(F.xxhash64("node"), "i_n").cast("int")).withColumn("j", F.pmod(F.xxhash64("node", F.lit(1)), "j_n").cast("int"))
    up_to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    as_member = rows.select("bucket", "node", "comp", F.lit(False).alias("stray"), up_to("i_n").alias("i"), "j")
    as_stray = rows.where("comp <> most").select("bucket", "node", "comp", F.lit(True).alias("stray"), "i", up_to("j_n").alias("j"))
    blocks = as_member.unionByName(as_stray).join(sets.select("node", "shingles"), "node")
    return blocks.groupBy("bucket", "i", "j").applyInArrow(compared, "a long, b long")


def verified(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of nodes that links of the similarity connect, from met(key, node)."""
    sizes = met.groupBy("key").agg(F.count("*").alias("size"))
    largest = met.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("degree"), F.max(F.struct("size", "key")).alias("most"))
    met = written(met.join(largest, "node").select("key", "node", "degree", (F.col("key") == F.col("most.key")).alias("first")))
    comps, turn, strays = None, 0, float("inf")
    while True:
        part = met if turn else met.where("first")
        own = part.withColumn("comp", F.col("node")) if comps is None else part.join(comps, "node", "left").select(*part.columns, F.coalesce("root", "node").alias("comp"))
        own = written(own)
        by_comp = own.groupBy("key", "comp").agg(F.count("*").alias("n"), F.max(F.struct("degree", "node")).alias("c"))
        state = by_comp.groupBy("key").agg(F.sum("n").alias("m"), F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("big"), F.max(F.struct("c.degree", "c.node", "comp")).alias("centre"))
        state = written(state.where("comps > 1"))
        work = state.agg(F.sum("m").alias("nodes"), F.sum(F.col("m") - F.col("big.n")).alias("strays"), F.sum((F.col("m") - F.col("big.n")) * F.col("m")).cast("double").alias("pairs")).first()
        if turn and not work.nodes:
            break
        # turns end when little is left, or when they connect little of it
        last = turn > TURNS or (turn > 0 and work.pairs <= LITTLE * work.nodes) or (turn > 2 and work.strays > 0.75 * strays)
        strays = work.strays if turn else strays
        if last:
            links = rest_of(own.join(state.select("key"), "key", "left_semi"), sets)
        else:
            open_ = own.join(state.select("key", F.col("centre.node").alias("centre"), F.col("centre.comp").alias("theirs")), "key")
            links = similar(open_.where("comp <> theirs").select("node", "centre").distinct(), sets)
            if turn:  # what concerns the centre is decided in a key only once all its nodes were compared
                met = written(open_.where("node <> centre").select(*met.columns))
        turn += 1
        before = [] if comps is None else [comps.select(F.col("node").alias("a"), F.col("root").alias("b"))]
        comps = written(components(functools.reduce(DataFrame.unionByName, [written(links), *before])))
        if last:
            break
    return comps


def groups(docs: DataFrame, words: int, radius: int, tables: int) -> DataFrame:
    """(doc_id, text_hash, root) for every row of docs(doc_id, text): rows of one root are near copies."""
    names = columns_of(tables)
    rows = written(marked(docs, words, tables))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = written(rows.groupBy("node").agg(F.min(row).alias("row"), *(F.first(n).alias(n) for n in names), F.first("keys").alias("keys")))
    prints = written(nodes.groupBy(*names).agg(F.count("*").alias("n")))
    near = linked(prints, names, radius).select(F.col("node").alias("fp"), "root")
    # what SimHash links is one more key
    keyed = nodes.join(near, "fp", "left").select("node", F.explode(F.concat("keys", F.array(F.coalesce("root", "fp").bitwiseXOR(F.lit(0x2545F4914F6CDD1D))))).alias("key"))
    keyed = written(keyed)
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    met = written(keyed.join(small(shared, shared.count()), "key"))
    members = written(nodes.join(met.select("node").distinct(), "node").select("node", F.col("row.doc_id").alias("_doc"), F.col("row.text_hash").alias("_text")))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    found = own.join(small(members, members.count()), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_text")))
    roots = verified(met, written(shingle_sets(found.select("node", "text"), words)))
    return rows.join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
