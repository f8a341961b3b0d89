"""SimHash near-duplicates: fingerprints, exact Hamming links through vantage-point trees, groups.

1. `fingerprints`: one 64-bit SimHash for each document over its word shingles.
2. Equal fingerprints are grouped first, so copies cost one entry and no pair.
3. `links`: a vantage-point tree over a bounded sample of fingerprints deals all fingerprints into
   shards by their Hamming distances to its vantage points. A fingerprint whose distance is within
   the radius of a boundary also goes to the shard beyond it, as the triangle bound demands, so any
   two fingerprints within the radius meet in the shard that one of them belongs to. Each shard
   builds its own vantage-point tree and queries it with all that it got.
4. A shard returns a spanning forest of its links, not the links: a group of n has n - 1 rows. The
   forests of all shards connect exactly what the links connect.
5. `components`: alternating stars over distributed tables, until nothing changes.

Defined cases: an empty table gives an empty result; very long texts count whole; texts without words (null, empty, white space) have fingerprint zero and link like
any other; repeated rows stay repeated rows with the same component; a null doc_id is kept, its
component is the smallest doc_id of its group, or null if there is none; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .textcore import flat, slices
from .words import spread_join

#: Bytes of text whose shingles are hashed at once.
SLICE_BYTES = 2 << 20
#: Fingerprints that the routing tree is fitted on: at least, for each shard, and at most. The tree
#: decides where work is done, not the result; with the most it has shards for 1e10 fingerprints.
TREE_SAMPLE, SHARD_SAMPLE, MOST_SAMPLE = 16_384, 12, 1_000_000
#: Fingerprints that a shard should own. Each level of the routing tree copies what lies at its
#: boundary, so shards are as large as a task can search in seconds.
SHARD_ROWS = 120_000
#: Copies of the root of a group, so that many rows of one group are joined to it in several tasks.
SALTS = 8
#: Edges whose components one process finds: two numbers each, 2 MB.
FEW_EDGES = 1 << 17
#: A local tree stops splitting here and compares all with all.
LEAF_ROWS = 512


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    return lower, white


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by single spaces: buffer, where each word begins and ends, words by document."""
    lower, white = _tables()
    low = lower[data]
    visible = ~white[low]
    docs = len(offsets) - 1
    first = np.zeros(len(low) + 1, bool)
    first[offsets] = True
    begin = visible.copy()
    if len(low):
        begin[1:] &= ~visible[:-1] | first[1 : len(low)]
    at = np.flatnonzero(begin)
    stop = visible.copy()
    if len(low):
        stop[:-1] &= ~visible[1:] | first[1 : len(low)]
    until = np.flatnonzero(stop) + 1
    sizes = until - at
    counts = np.diff(np.searchsorted(at, offsets))
    # each word is moved behind the one before, with a space between
    out = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    keep = np.ones(len(out), bool)
    keep[starts + sizes] = False
    out[keep] = low[visible]
    assert len(counts) == docs
    return out.tobytes(), starts, starts + sizes, counts


def votes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each document the bits that are set in over half of its hashes."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    begins = (np.cumsum(counts) - counts)[full]
    half = counts[full]
    # four 16-bit counters in a word hold 65535 rows at most, so long documents are summed in pieces
    step = 60_000
    cuts = np.unique(np.concatenate([begins, *(np.arange(b, b + n, step) for b, n in zip(begins[half > step], half[half > step], strict=True))]))
    owner = np.searchsorted(begins, cuts, side="right") - 1
    spread = np.array([sum(((nibble >> k) & 1) << (16 * k) for k in range(4)) for nibble in range(16)], np.uint64)
    for nibble in range(16):
        sums = np.add.reduceat(spread[(hashes >> np.uint64(4 * nibble)) & np.uint64(15)], cuts)
        for k in range(4):
            ones = np.bincount(owner, ((sums >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.float64), len(full))
            out[full] |= (2 * ones > half).astype(np.uint64) << np.uint64(4 * nibble + k)
    return out


def mixed(hashes: np.ndarray, table: int) -> np.ndarray:
    """Hashes for another table, independent of those for the first: the finaliser of splitmix64."""
    if not table:
        return hashes
    x = hashes + np.uint64(table * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, Iterator[bytes]]:
    """Hashes of all shingles of `words` words (a shorter text is one), how many each text has, and its words."""
    buffer, begins, ends, counts = normalised(*flat(column))
    first = np.cumsum(counts) - counts
    shingles = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    start = np.repeat(first - (np.cumsum(shingles) - shingles), shingles) + np.arange(int(shingles.sum()))
    stop = np.minimum(start + words, np.repeat(first + counts, shingles)) - 1
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(buffer[a:b], 42) for a, b in zip(begins[start].tolist(), ends[stop].tolist(), strict=True)), np.uint64, len(start))
    return hashes, shingles, (buffer[begins[f] : ends[f + n - 1]] if n else b"" for f, n in zip(first.tolist(), counts.tolist(), strict=True))


def fingerprint_slice(column: pa.Array, words: int, tables: int = 1) -> list[np.ndarray]:
    """SimHashes of texts, for each table, over shingles of `words` words (a shorter text is one shingle)."""
    hashes, shingles, _ = shingle_hashes(column, words)
    return [votes(mixed(hashes, t), shingles) for t in range(tables)]


def columns_of(tables: int) -> list[str]:
    return ["fp", *(f"fp{t}" for t in range(1, tables))]


def fingerprints(docs: DataFrame, words: int, tables: int = 1) -> DataFrame:
    """(doc_id, fp long, and fp1 ... for further tables) for every row of docs(doc_id, text)."""
    names = columns_of(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = fingerprint_slice(part.column("text"), words, tables)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(fp.view(np.int64)) for fp in found)], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def distance(a: np.ndarray, b: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def grow(points: np.ndarray, leaf: int, rng: np.random.Generator) -> list:
    """A vantage-point tree as nested lists: [vantage, threshold, near, far], or None for a leaf."""
    if len(points) <= leaf:
        return None
    # of a few vantage points the one whose median ring is thinnest, so that few lie at its boundary
    best = None
    for v in points[rng.integers(0, len(points), 8)]:
        d = distance(points, v)
        mid = int(np.median(d))
        near = d <= mid
        if near.all():
            mid = int(d.max()) - 1
            near = d <= mid
        if near.any() and not near.all():
            ring = np.mean(np.abs(d - mid) <= 2) + abs(near.mean() - 0.5)
            if best is None or ring < best[0]:
                best = ring, v, mid, near
    if best is None:
        return None
    _, v, mid, near = best
    return [int(v), mid, grow(points[near], leaf, rng), grow(points[~near], leaf, rng)]


def route(tree: list, points: np.ndarray, radius: int, own: np.ndarray | None = None, path: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Leaves with the numbers of the points that must be there, and whether they belong there."""
    stack = [(tree, np.arange(len(points)), np.ones(len(points), bool), path)]
    while stack:
        node, at, mine, path = stack.pop()
        if not len(at):
            continue
        if node is None:
            yield path, at, mine
            continue
        v, mid, near, far = node
        d = distance(points[at], np.uint64(v))
        left, right = d <= mid + radius, d > mid - radius
        stack.append((near, at[left], mine[left] & (d[left] <= mid), 2 * path))
        stack.append((far, at[right], mine[right] & (d[right] > mid), 2 * path + 1))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the edges (a, b) connect it to."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def forest(points: np.ndarray, mine: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links within the radius that involve a point of this shard."""
    rng = np.random.default_rng(len(points))
    tree = grow(np.sort(points[mine]), LEAF_ROWS, rng)
    root = np.arange(len(points))
    for _, at, here in route(tree, points, radius):
        own = at[here & mine[at]]
        if not len(own):
            continue
        for lo in range(0, len(own), 256):  # a group of near copies is reduced before the next rows add to it
            near = np.bitwise_count(points[own[lo : lo + 256], None] ^ points[None, at]) <= radius
            i, j = np.nonzero(near)
            i, j = root[own[lo + i]], root[at[j]]
            root = roots(len(points), i[i != j], j[i != j])[root] if (i != j).any() else root
    moved = np.flatnonzero(root != np.arange(len(points)))
    return moved, root[moved]


def routing_tree(fps: DataFrame) -> list:
    """A tree over a sample of the fingerprints whose leaves own about SHARD_ROWS of them all."""
    n = fps.count()
    want = min(max(TREE_SAMPLE, n // SHARD_ROWS * SHARD_SAMPLE), MOST_SAMPLE)
    # hashes below a bound that somewhat more than `want` reach: a sample independent of the fingerprints' order
    near = fps.select("fp", F.xxhash64("fp").alias("h")).where(F.col("h").cast("double") <= -(2.0**63) + (1.1 * want + 1000) / max(n, 1) * 2.0**64)
    table = near.toArrow()
    order = np.lexsort((table.column("fp").to_numpy(), table.column("h").to_numpy()))[:want]
    sample = table.column("fp").to_numpy()[order].view(np.uint64)
    leaf = max(SHARD_SAMPLE * 2 // 3, int(len(sample) * SHARD_ROWS / max(n, 1)))
    return grow(np.sort(sample), leaf, np.random.default_rng(7))


def links(tables: list[DataFrame], radius: int) -> DataFrame:
    """(t, a, b): for each table of distinct fingerprints `fp`, by its place, spanning edges of its links within the radius.

    The shards of all tables are searched side by side.
    """

    def deal(t: int, tree: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                for shard, at, mine in route(tree, points, radius):
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, shard, np.int64)), pa.array(points[at].view(np.int64)), pa.array(mine)], ["t", "shard", "fp", "mine"])

        return run

    def search(table: pa.Table) -> pa.Table:
        points = table.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(points)
        points, mine = points[order], table.column("mine").to_numpy(zero_copy_only=False)[order]
        a, b = forest(points, mine, radius)
        return pa.table({"t": pa.array(np.full(len(a), table.column("t")[0].as_py()), pa.int32()), "a": points[a].view(np.int64), "b": points[b].view(np.int64)})

    dealt = [fps.select("fp").mapInArrow(deal(t, routing_tree(fps)), "t int, shard long, fp long, mine boolean") for t, fps in enumerate(tables)]
    return functools.reduce(DataFrame.unionByName, dealt).groupBy("t", "shard").applyInArrow(search, "t int, a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) that is connected to a smaller one: the smallest.

    Alternates large-star and small-star: each node links what it is linked to with the smallest of
    them, until the edges are stars. Each round halves what is left of a chain, and a round's rows
    are at most those of the one before. Neighbour minima are aggregates, so no list is gathered;
    adaptive execution splits the joins of a node with very many neighbours, whose rows are two numbers.
    At most FEW_EDGES edges are counted, then brought together, for rounds over few edges cost jobs and files alone.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.count() <= FEW_EDGES:
        table = edges.toArrow()
        nodes, at = np.unique(np.concatenate([table.column(c).to_numpy() for c in "uv"]), return_inverse=True)
        root = nodes[roots(len(nodes), *np.split(at, 2))]
        moved = root != nodes
        return edges.sparkSession.createDataFrame(pa.table({"node": nodes[moved], "root": root[moved]}), "node long, root long")
    # two tables of distinct edges are taken for equal if their numbers and two sums of hashes are
    row = F.xxhash64("u", "v")
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(row), F.sum(row.bitwiseAND(F.lit((1 << 31) - 1)))).first())
    state = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, before = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()), state
        state = mark(edges)
        if state == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def linked(least: DataFrame, names: list[str], radius: int) -> DataFrame:
    """(node, root) for every fingerprint of the first column of `names` that links of any of them tie to another."""
    own = [least.groupBy(F.col(c).alias("fp")).agg(F.count("*").alias("n")) for c in names]
    found = written(links(own, radius))
    edges = found.where("t = 0").select("a", "b")
    # a node is a fingerprint, told apart by its table
    node = lambda c, t: F.col(c).bitwiseXOR(F.lit(t * 0x2545F4914F6CDD1D % (1 << 63)))
    for t in range(1, len(names)):
        linked = found.where(F.col("t") == t)
        # only fingerprints that are shared or linked in this table tie anything together
        ties = linked.select(F.col("a").alias("x")).unionByName(linked.select(F.col("b").alias("x"))).unionByName(own[t].where("n > 1").select(F.col("fp").alias("x"))).distinct()
        members = least.join(ties, F.col(f"fp{t}") == F.col("x"), "left_semi").select(F.col("fp").alias("a"), node(f"fp{t}", t).alias("b"))
        edges = edges.unionByName(linked.select(node("a", t).alias("a"), node("b", t).alias("b"))).unionByName(members)
    return components(edges)


def groups(docs: DataFrame, words: int, radius: int, tables: int = 1) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text).

    Two documents link if their fingerprints of any table are within the radius. Each table hashes
    the shingles anew, so near copies that one table misses are met by another.
    """
    names = columns_of(tables)
    marked = written(fingerprints(docs, words, tables))
    least = written(marked.groupBy(*names).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = linked(least, names, radius)
    # (fp, root), then the smallest doc_id of each root
    # of a large group many rows meet one root, which is copied to several places
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt")
    rooted = least.groupBy("fp").agg(F.min("least").alias("least"), F.sum("n").alias("n")).join(found, F.col("fp") == found.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    tied = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")).where("fps > 1")
    tied = tied.select("root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    by_fp = rooted.select("*", salt).join(tied, ["root", "salt"], "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return spread_join(marked.select("doc_id", "fp"), by_fp, "fp", ["doc_id"])


def op8_simhash_groups(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of `documents`: three-word shingles, fingerprints at most two bits apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = groups(docs, words=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
