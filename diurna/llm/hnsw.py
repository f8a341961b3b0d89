"""Approximate nearest neighbours by inner product: navigable small-world graphs for each shard.

1. Vectors are dealt into shards of about SHARD_ROWS by a hash of their id.
2. Within a shard, vectors are parted into bands of like length: the longest of a band is at most BAND
   times as long as its shortest. Each band builds its graph: the layers of a hierarchical navigable
   small world, each a flat array of neighbour numbers (-1: none). A shard has a bounded size, so a
   node's candidates are found exactly, by blocks, and pruned by the usual rule: a candidate is kept
   if it is nearer to the node than to any neighbour kept before. Equal vectors are one node with its
   smallest ids. The graphs are written to shared storage and are the index.
3. Every query visits every shard and there the bands from the longest down, as long as the product of
   the lengths allows a score among its best: from the top layer, whose nodes are all entries, a beam
   search goes down the layers. All queries of a batch step together.
4. Shards return their nearest with exact scores in double precision, and these are merged.

Inner products become distances by one more coordinate that gives all vectors of a band one length;
as these are of like length, that coordinate is small. Vectors and queries are scaled before they are
rounded to single precision, so their magnitude does not matter.

Defined cases: vectors that are null, empty, zero or hold a null, NaN or infinite component, and
rows with a null id take no part; only vectors of equal length are compared; rows equal in id and
vector count once, and of an id with several vectors the one with the best score counts; a query id
with several vectors asks with the smallest; a score beyond the range of doubles is infinite, one that
is no number counts as least; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Vectors of one shard, about.
SHARD_ROWS = 32_768
#: Length of the longest vector of a band, as a multiple of the shortest.
BAND = 1.2
#: Queries that one task should take through a shard.
QUERY_ROWS = 20_000
#: Neighbours of a node in the bottom layer and above it; candidates that they are picked from.
NEAR, NEAR_ABOVE, CANDIDATES = 32, 16, 96
#: Width of the beam below and above; nodes of each query that a step expands.
BEAM, BEAM_ABOVE, AT_ONCE = 320, 32, 4
#: A layer of at most this many nodes is the top; all its nodes are entries.
TOP = 64
LAYER_SHARE = 16


def neighbours(x: np.ndarray, near: int) -> np.ndarray:
    """Flat neighbour array of one layer over vectors of one length: n x near numbers, -1 for none."""
    n = len(x)
    want = min(CANDIDATES, n - 1)
    if want <= 0:
        return np.full((n, near), -1, np.int32)
    edges_a, edges_b, edges_s = [], [], []
    for lo in range(0, n, 256):
        block = x[lo : lo + 256]
        sims = block @ x.T
        rows = np.arange(len(block))
        sims[rows, lo + rows] = -np.inf
        cand = np.argpartition(-sims, want - 1, axis=1)[:, :want]
        own = np.take_along_axis(sims, cand, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        cand, own = np.take_along_axis(cand, order, 1), np.take_along_axis(own, order, 1)
        among = x[cand]
        among = among @ among.transpose(0, 2, 1)
        kept = np.zeros(cand.shape, bool)
        for j in range(want):
            covered = (kept & (among[:, j, :] >= own[:, j, None])).any(axis=1)
            kept[:, j] = ~covered & (kept.sum(axis=1) < near)
        # what is left over is filled with the nearest others
        rank = np.argsort(~kept, axis=1, kind="stable")[:, :near]
        edges_a.append(np.repeat(lo + rows, rank.shape[1]))
        edges_b.append(np.take_along_axis(cand, rank, 1).ravel())
        edges_s.append(np.where(np.take_along_axis(kept, rank, 1), 4.0, 0.0).ravel() + np.take_along_axis(own, rank, 1).ravel())
    a, b, s = np.concatenate(edges_a), np.concatenate(edges_b), np.concatenate(edges_s)
    # links hold both ways; of too many the kept and nearest stay
    a, b, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
    order = np.lexsort((-s, b, a))
    a, b, s = a[order], b[order], s[order]
    fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    a, b, s = a[fresh], b[fresh], s[fresh]
    order = np.lexsort((-s, a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    inside = rank < near
    flat = np.full((n, near), -1, np.int32)
    flat[a[inside], rank[inside]] = b[inside]
    return flat


def log_lengths(x: np.ndarray) -> np.ndarray:
    """Logarithms of the Euclidean lengths, also of vectors whose squares no double holds."""
    most = np.abs(x).max(axis=1)
    return np.log(most) + 0.5 * np.log(((x / most[:, None]) ** 2).sum(axis=1))


def build(ids: np.ndarray, vectors: np.ndarray, keep_ids: int) -> list[dict]:
    """The index of one shard: for each band, from the longest down, distinct vectors, the smallest ids of each, and its layers."""
    vectors = vectors + 0.0  # no negative zero
    _, node, same = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * vectors.itemsize}").ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, same))
    same, ids = same[order], ids[order]
    fresh = np.append(True, (same[1:] != same[:-1]) | (ids[1:] != ids[:-1]))  # rows equal in id and vector count once
    same, ids = same[fresh], ids[fresh]
    rank = np.arange(len(same)) - np.searchsorted(same, same)
    inside = rank < keep_ids
    table = np.full((len(node), min(keep_ids, int(rank.max()) + 1)), -1, np.int64)
    taken = np.zeros(table.shape, bool)
    table[same[inside], rank[inside]] = ids[inside]
    taken[same[inside], rank[inside]] = True
    x = vectors[node]
    logs = log_lengths(x)
    down = np.argsort(-logs, kind="stable")
    bands, at = [], 0
    while at < len(down):
        upto = int(np.searchsorted(-logs[down], -(logs[down[at]] - np.log(BAND)), side="right"))
        rows = down[at:upto]
        bands.append({"x": x[rows], "ids": table[rows], "taken": taken[rows], "longest": logs[rows[0]], **layers_of(x[rows], logs[rows])})
        at = upto
    return bands


def layers_of(x: np.ndarray, logs: np.ndarray) -> dict:
    """The vectors of a band, all made of one length, and the layers of their graph."""
    most = np.abs(x).max(axis=1, keepdims=True)
    # by way of the largest component and the logarithm, as lengths may be beyond doubles
    unit = (x / most) * np.exp(np.log(most) - logs.max())
    pad = np.sqrt(np.maximum(0, 1 - (unit**2).sum(axis=1, keepdims=True)))
    unit = np.concatenate([unit, pad], axis=1).astype(np.float32)
    layers, size = [], len(x)
    shuffled = np.random.default_rng(len(x)).permutation(len(x))
    while True:
        members = shuffled[:size]
        layers.append((members.astype(np.int32), neighbours(unit[members], NEAR if not layers else NEAR_ABOVE)))
        if size <= TOP:
            break
        size = max(TOP, size // LAYER_SHARE)
    return {"unit": unit, "layers": layers}


def beam(unit: np.ndarray, flat: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> np.ndarray:
    """For each query up to `width` nodes (-1: none), the nearest that the search from its entries finds."""
    q, n = len(queries), len(unit)
    seen = np.zeros((q, n + 1), bool)  # the last column stands for no node
    rows = np.arange(q)[:, None]
    padded = np.concatenate([unit, np.zeros((1, unit.shape[1]), unit.dtype)])

    def scored(nodes: np.ndarray, of: np.ndarray) -> np.ndarray:
        s = np.matmul(padded[nodes], queries[of][:, :, None])[:, :, 0]
        return np.where(nodes == n, -np.inf, s)

    ids = np.where(entries < 0, n, entries)
    seen[rows, ids] = True
    sims = scored(ids, np.arange(q))
    if ids.shape[1] < width:
        ids = np.concatenate([ids, np.full((q, width - ids.shape[1]), n)], axis=1)
        sims = np.concatenate([sims, np.full((q, width - sims.shape[1]), -np.inf)], axis=1)
    done = ids == n
    active = np.arange(q)
    while len(active):
        open_sims = np.where(done[active], -np.inf, sims[active])
        pick = np.argpartition(-open_sims, AT_ONCE - 1, axis=1)[:, :AT_ONCE] if open_sims.shape[1] > AT_ONCE else np.argsort(-open_sims, axis=1)
        useful = np.take_along_axis(open_sims, pick, 1) > -np.inf
        some = useful.any(axis=1)
        active, pick, useful = active[some], pick[some], useful[some]
        if not len(active):
            break
        chosen = np.take_along_axis(ids[active], pick, 1)
        flags = done[active]
        np.put_along_axis(flags, pick, True, 1)
        found = np.where(useful[:, :, None], flat[np.where(useful, chosen, 0)], -1).reshape(len(active), -1)
        found = np.where(found < 0, n, found)
        known = seen[active[:, None], found]
        found = np.where(known, n, found)
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = n
        seen[active[:, None], found] = True
        seen[:, n] = False
        all_ids = np.concatenate([ids[active], found], axis=1)
        all_sims = np.concatenate([sims[active], scored(found, active)], axis=1)
        all_done = np.concatenate([flags, found == n], axis=1)
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[active] = np.take_along_axis(all_ids, best, 1)
        sims[active] = np.take_along_axis(all_sims, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    ids = np.take_along_axis(ids, order, 1)
    return np.where(ids == n, -1, ids)


def search(bands: list[dict], query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vec_id, score) of the nearest that the graphs find, at most k for each query."""
    lengths = log_lengths(queries)
    q32 = (queries / np.abs(queries).max(axis=1, keepdims=True)).astype(np.float32)
    q32 = np.concatenate([q32, np.zeros((len(q32), 1), np.float32)], axis=1)
    best_ids, best = [np.zeros(0, np.int64) for _ in queries], [np.zeros(0) for _ in queries]
    for band in bands:
        with np.errstate(over="ignore"):
            bound = np.exp(lengths + band["longest"]) * (1 + 1e-9)
        asking = np.array([i for i in range(len(queries)) if len(best[i]) < k or not best[i][-1] > bound[i]], np.int64)
        if not len(asking):
            continue
        nodes, found = visited(band, q32[asking])
        ids = band["ids"][nodes]
        valid = found[:, :, None] & band["taken"][nodes] & (ids != query_ids[asking][:, None, None])
        for row, i in enumerate(asking):
            with np.errstate(over="ignore", invalid="ignore"):
                s = (band["x"][nodes[row]] * queries[i]).sum(axis=1)
            at, which = np.nonzero(valid[row])
            all_ids, all_s = np.append(best_ids[i], ids[row][at, which]), np.append(best[i], np.where(np.isnan(s), -np.inf, s)[at])
            order = np.lexsort((all_ids, -all_s))
            # of an id with several vectors the best score stays
            _, first = np.unique(all_ids[order], return_index=True)
            order = order[np.sort(first)][:k]
            best_ids[i], best[i] = all_ids[order], all_s[order]
    return np.repeat(np.arange(len(queries)), [len(x) for x in best]), np.concatenate(best_ids), np.concatenate(best)


def visited(band: dict, q32: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the nodes that the beam search finds, and whether each place holds one."""
    members, _ = band["layers"][-1]
    entries = np.broadcast_to(np.arange(len(members)), (len(q32), len(members)))
    for level in range(len(band["layers"]) - 1, -1, -1):
        members, flat = band["layers"][level]
        # upper layers are the first of the shuffled nodes, so a node's number is the same below
        entries = beam(band["unit"][members], flat, q32, entries, max(BEAM if level == 0 else BEAM_ABOVE, entries.shape[1]))
    return band["layers"][0][0][np.where(entries < 0, 0, entries)], entries >= 0


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>, dim) of the rows that take part."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(e, lambda v: v != 0)).withColumn("dim", F.size(e))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def make_index(vectors: DataFrame, keep_ids: int) -> tuple[DataFrame, int]:
    """(shard, graph) rows in shared storage, and the number of shards for each vector length."""
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    keyed = vectors.withColumn("shard", F.col("dim").cast("long") * (1 << 32) + F.pmod(F.xxhash64("vec_id"), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        index = build(table.column("vec_id").to_numpy(), _matrix(table.column("embedding")), keep_ids)
        return pa.table({"shard": [table.column("shard")[0].as_py()], "graph": pa.array([pickle.dumps(index, 5)], pa.binary())})

    return written(keyed.select("shard", "vec_id", "embedding").groupBy("shard").applyInArrow(run, "shard long, graph binary")), shards


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k best that the graphs find, itself excepted."""
    vectors = usable(vectors)
    index, shards = make_index(vectors, k + 1)
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    salts = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(salts)))
    visits = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(
        (F.size("embedding").cast("long") * (1 << 32) + F.col("shard")).alias("shard"), "salt", "vec_id", "embedding", F.lit(None).cast("binary").alias("graph")
    )
    graphs = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(
        "shard", F.col("salt").cast("long").alias("salt"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("embedding"), "graph"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index = None, None
        for batch in batches:
            keys = batch.column("shard").to_numpy()
            is_graph = batch.column("graph").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | is_graph[1:] | is_graph[:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
                if is_graph[a]:
                    shard, index = keys[a], pickle.loads(batch.column("graph")[int(a)].as_py())
                elif index is not None and shard == keys[a]:  # a vector length without a graph has no candidates
                    for lo in range(a, b, 512):
                        part = batch.slice(lo, min(512, b - lo))
                        own = part.column("vec_id").to_numpy()
                        q, ids, s = search(index, own, _matrix(part.column("embedding")), k)
                        yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(ids), pa.array(s)], ["query_id", "vec_id", "score"])

    parts = max(shards * salts, 1)
    found = (
        graphs.unionByName(visits)
        .repartition(parts, "shard", "salt")
        .sortWithinPartitions("shard", "salt", F.col("graph").isNull())
        .mapInArrow(run, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth row of `embeddings`, among all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)
