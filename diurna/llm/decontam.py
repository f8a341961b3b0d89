"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

1. Every text and every benchmark item becomes its words and the hashes of its shingles of WORDS
   words. An item of n words is compared with windows of n words of the texts.
2. Only windows that hold enough shingles of items of their size can be similar to one. So the rolling
   shingle hashes of all texts are joined to the items' shingles, and every start whose window has
   that many hits, in whatever order, gets a window. No other window can pass the check in 4.
3. Windows and items get 64-bit SimHashes, cut into BLOCKS blocks. Of fingerprints within RADIUS bits
   at least one block differs in no more than RADIUS // BLOCKS bits. Items enter the index with every
   value that a block can take so, windows look up their own values: a join on size, block number and
   block value finds all within the radius, and of others about one in five.
4. Candidates are verified exactly: the weighted Jaccard similarity of the two bags of shingles
   (least over greatest number of times, summed) must reach SIMILARITY.

Items are few, so their tables are broadcast if they are counted to be small; otherwise they are
shuffled. So are the starts; texts are shuffled only if there are too many starts to broadcast. RADIUS
is so wide that a pair at the similarity is beyond it with a chance of about one in two thousand (64
bits, 27 degrees).

Defined cases: without documents nothing is found; very long texts are searched whole; of windows of
equal similarity the first counts; null and empty texts and items without words take no part; an item with fewer words
than a shingle is one shingle; a text shorter than an item is one window; texts equal in doc_id and
content count once; extra columns are ignored; without items nothing is found.
"""

from __future__ import annotations

# Generators here are outer ones, as for others Spark derives a filter that repeats the tokenising below them.
import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import rolling, small

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\xBF\u2000-\u206F\u3000-\u303F]+"
WORDS = 5
SIMILARITY = 0.8
RADIUS, BLOCKS = 19, 5
#: Bits at which the blocks begin, and the end.
CUTS = [64 * k // BLOCKS for k in range(BLOCKS + 1)]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def shingles(words: Column) -> Column:
    """Hashes of all shingles; of fewer words all together are one."""
    whole = F.array(F.xxhash64(words))
    return F.when(F.size(words) >= WORDS, rolling(words, WORDS)).when(F.size(words) > 0, whole).otherwise(F.array().cast("array<long>"))


def simhash(hashes: Column) -> Column:
    """Bits set in over half of the hashes."""
    bits = F.array(*(F.lit((1 << k) if k < 63 else -(1 << 63)).cast("long") for k in range(64)))
    ones = lambda bit: F.size(F.filter(hashes, lambda h: h.bitwiseAND(bit) != 0))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, bit: F.when(2 * ones(bit) > F.size(hashes), acc.bitwiseOR(bit)).otherwise(acc))


def blocks(fp: Column) -> list[Column]:
    """The values of the blocks."""
    return [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) for a, b in zip(CUTS, CUTS[1:], strict=False)]


def _key(n: Column, block: int, value: Column) -> Column:
    """Size, block number and block value in one number."""
    return F.shiftleft(n.cast("long"), 24).bitwiseOR(F.lit(block << 16).cast("long")).bitwiseOR(value)


def looked_up(n: Column, fp: Column) -> Column:
    """The keys of all blocks, as a window looks them up."""
    return F.array(*(_key(n, k, v) for k, v in enumerate(blocks(fp))))


def entered(n: Column, fp: Column) -> Column:
    """The keys of every value within RADIUS // BLOCKS bits of a block, as an item enters the index."""

    def of(k: int, value: Column, bits: int) -> Column:
        masks = [sum(1 << i for i in flips) for many in range(RADIUS // BLOCKS + 1) for flips in itertools.combinations(range(bits), many)]
        return F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: _key(n, k, value.bitwiseXOR(m)))

    return F.concat(*(of(k, v, b - a) for k, (v, a, b) in enumerate(zip(blocks(fp), CUTS, CUTS[1:], strict=False))))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two bags."""
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))


def starts(places: Column, n: Column, length: Column) -> Column:
    """First words of all windows of n words that hold as many of the places as the similarity needs.

    The k-th places from each on span the starts between them; each place adds those behind the one before.
    """
    inside = F.greatest(F.least(n, length) - (WORDS - 1), F.lit(1))
    need = F.ceil((inside + F.greatest(n - (WORDS - 1), F.lit(1))) * F.lit(SIMILARITY / (1 + SIMILARITY)) - F.lit(1e-6)).cast("int")
    last = F.greatest(length - n, F.lit(0))

    def of(p: Column, j: Column) -> Column:
        before = F.when(j > 0, F.get(places, j - 1)).otherwise(F.lit(-1))
        low = F.greatest(F.get(places, j + need - 1) - inside + 1, before + 1, F.lit(0))
        high = F.least(p, last)
        return F.when(F.get(places, j + need - 1).isNotNull() & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(places, of))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, first_word, n_words, distance, similarity): the best window of each text for each item."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("words"))
    # what others build on is written once, as Spark would repeat such expressions wherever they are used
    items = items.where(F.size("words") > 0).select("item_id", F.size("words").alias("n"), shingles(F.col("words")).alias("bag"))
    items = written(items.withColumn("item", F.monotonically_increasing_id()))
    places = items.select("n", F.explode_outer("bag").alias("hash")).distinct()
    n_places = items.agg(F.sum(F.size("bag"))).first()[0] or 0
    # short items are whole windows of their own few words
    short = [r.n for r in items.where(F.col("n") < WORDS).select("n").distinct().collect()]

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("own"))
    own = F.col("own")
    whole = lambda n: F.transform(F.sequence(F.lit(0), F.size(own) - n), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(own, i + 1, n)).alias("hash")))
    none = F.array().cast("array<struct<at:int,hash:bigint>>")
    guarded = [F.transform(shingles(own), lambda h, i: F.struct(i.alias("at"), h.alias("hash"))), *(F.when(F.size(own) >= n, whole(n)).otherwise(none) for n in short)]
    runs = texts.select("doc_id", "text_hash", F.size("own").alias("length"), reduce(F.concat, guarded).alias("runs")).select("doc_id", "text_hash", "length", F.explode_outer("runs").alias("r")).select("doc_id", "text_hash", "length", "r.at", "r.hash")

    hit = runs.join(small(places, n_places, 24), "hash")
    dense = hit.groupBy("doc_id", "text_hash", "n").agg(F.array_sort(F.collect_set("at")).alias("places"), F.first("length").alias("length"))
    dense = dense.select("doc_id", "text_hash", "n", starts(F.col("places"), F.col("n"), F.col("length")).alias("starts"))
    dense = written(dense.where(F.size("starts") > 0).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"), "n", "starts"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    n_dense = dense.agg(F.sum(F.size("starts"))).first()[0] or 0
    held = ids.join(small(dense, n_dense), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_text")))
    held = written(held.select("doc_id", "text_hash", "n", "starts", words_of(F.col("text")).alias("own")))
    cut = F.transform("starts", lambda s: F.struct(s.alias("first_word"), F.slice("own", s + 1, F.col("n")).alias("words")))
    windows = held.select("doc_id", "text_hash", "n", F.inline_outer(cut)).dropDuplicates(["doc_id", "text_hash", "n", "first_word"])
    windows = windows.select("doc_id", "text_hash", "n", "first_word", shingles(F.col("words")).alias("bag"))
    windows = written(windows.withColumn("window", F.monotonically_increasing_id()))

    prints = written(items.select("item", "n", simhash(F.col("bag")).alias("item_fp")))
    index = written(prints.select("item", F.explode_outer(entered(F.col("n"), F.col("item_fp"))).alias("key")))
    found = written(windows.select("window", "n", simhash(F.col("bag")).alias("fp")))
    pairs = found.select("window", "fp", F.posexplode_outer(looked_up(F.col("n"), F.col("fp"))).alias("block", "key")).join(small(index, index.count(), 32), "key")
    pairs = pairs.join(small(prints.select("item", "item_fp"), items.count(), 32), "item")
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    # a pair that meets in several blocks is kept once, at the first of them
    first = F.array_position(F.array(*(F.bit_count(v) <= RADIUS // BLOCKS for v in blocks(apart))), True) - 1
    pairs = pairs.where((F.bit_count(apart) <= RADIUS) & (first == F.col("block"))).select("window", "item", F.bit_count(apart).alias("distance"))
    # bags follow only now, to pairs that are left
    bags = items.select("item", "item_id", F.col("bag").alias("item_bag"))
    width = 8 * (items.agg(F.max(F.size("bag"))).first()[0] or 0) + 32
    pairs = pairs.join(windows, "window").join(small(bags, items.count(), width), "item")
    pairs = pairs.withColumn("similarity", similarity(F.col("bag"), F.col("item_bag"))).where(F.col("similarity") >= SIMILARITY)
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("back"), "n", "distance")).alias("b")
    out = pairs.groupBy("doc_id", "text_hash", "item_id").agg(best)
    return out.select("doc_id", "text_hash", "item_id", (-F.col("b.back")).cast("long").alias("first_word"), F.col("b.n").cast("long").alias("n_words"), F.col("b.distance").cast("int").alias("distance"), F.col("b.similarity").alias("similarity"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no item."""
    bad = matches(docs, items).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text")).distinct()
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_text"))
    return docs.join(bad, own, "left_anti")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Passages of `benchmark` in every text of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "item_id", "first_word", "n_words", "similarity")


_SQL_WORD = WORD.replace(r"\u2000-\u206F\u3000-\u303F", r"\x{2000}-\x{206F}\x{3000}-\x{303F}")
#: The same rows in SQL, by all windows of texts that share a shingle with an item; for items of a shingle or more.
ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_SQL_WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{_SQL_WORD}') AS w FROM benchmark),
ds AS (SELECT doc_id, p, array_to_string(list_slice(w, p + 1, p + {WORDS}), ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - {WORDS - 1})) AS p FROM d WHERE len(w) >= {WORDS})),
sh AS (SELECT item_id, len(w) AS n, array_to_string(list_slice(w, p + 1, p + {WORDS}), ' ') AS g FROM (SELECT item_id, w, unnest(range(len(w) - {WORDS - 1})) AS p FROM i WHERE len(w) >= {WORDS})),
ic AS (SELECT item_id, n, g, count(*) AS c FROM sh GROUP BY 1, 2, 3),
pair AS (SELECT DISTINCT doc_id, item_id, n FROM ds JOIN ic USING (g)),
win AS (SELECT doc_id, item_id, n, least(n, len(w)) AS m, unnest(range(greatest(len(w) - n, 0) + 1)) AS s FROM pair JOIN d USING (doc_id)),
got AS (SELECT x.doc_id, x.item_id, x.n, x.m, x.s, ds.g, count(*) AS c FROM win x JOIN ds ON ds.doc_id = x.doc_id AND ds.p BETWEEN x.s AND x.s + x.m - {WORDS} GROUP BY ALL),
both_ AS (SELECT doc_id, item_id, n, m, s, sum(least(got.c, ic.c)) AS b FROM got JOIN ic USING (item_id, n, g) GROUP BY 1, 2, 3, 4, 5),
sim AS (SELECT *, b / ((m - {WORDS - 1}) + (n - {WORDS - 1}) - b) AS similarity FROM both_)
SELECT doc_id, item_id, CAST(arg_min(s, (-similarity, s)) AS BIGINT) AS first_word, CAST(any_value(n) AS BIGINT) AS n_words, CAST(max(similarity) AS DOUBLE) AS similarity FROM sim WHERE similarity >= {SIMILARITY} GROUP BY 1, 2
"""
