"""URL filters: dated list entries joined to captures as of their fetch time.

A list is a log of dated entries: from `listed_at` on an entry for a host or domain blocks, allows,
or is taken back. For each pattern the entries become intervals of validity, each up to the next
entry of the same pattern and list. A capture matches the patterns host, and each domain above it,
and of the entries in force when it was fetched the one with the longest pattern decides (ties:
block before allow, then the smallest list name).

The intervals are joined on the pattern with the fetch time inside; an instant at which one entry
ends and the next begins belongs to the next. Entries of one pattern are few, captures of one host
many: captures are never grouped by host. Intervals are broadcast if counted to be few and short;
otherwise each is copied to SALTS places and the captures are dealt among them, so that the captures
of a common host are joined by as many tasks.

Defined cases: an empty table of captures gives an empty result, and without entries nothing decides;
very long URLs are read whole; a host is tried with all its endings of whole labels, up to the most
labels that a listed pattern has; an address of IP version 6 is a host without its brackets, and only
whole; a null or unusable URL or fetch time matches nothing and is kept; entries without a pattern, date
or action are void; entries of one pattern, list and instant count as one, the last by action name;
repeated captures give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import BROADCAST_BYTES, BROADCAST_ROWS

#: Copies of each interval if they are too many to be broadcast.
SALTS = 8


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port, brackets and final dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]+)", 1))
    host = F.regexp_replace(host, r"\.$|[\[\]]", "")
    return F.nullif(host, F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, action, since, until): when each entry is in force. until is null for the last."""
    usable = entries.where(F.col("pattern").isNotNull() & F.col("listed_at").isNotNull() & F.col("action").isNotNull())
    usable = usable.groupBy("list", F.lower("pattern").alias("pattern"), "listed_at").agg(F.max("action").alias("action"))
    following = Window.partitionBy("list", "pattern").orderBy("listed_at")
    return usable.select("list", "pattern", "action", F.col("listed_at").alias("since"), F.lead("listed_at").over(following).alias("until"))


def decide(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """For each capture (page_id, url, fetched_at): host, and the entry that decides, or nulls."""
    spans = intervals(entries).where(F.col("action").isin("block", "allow"))
    labels = F.size(F.split("pattern", r"\."))
    size = spans.agg(F.count("*").alias("n"), F.sum(F.octet_length("pattern") + F.coalesce(F.octet_length("list"), F.lit(0)) + 64).alias("bytes"), F.max(labels).alias("labels")).first()
    rows = captures.select("page_id", "url", "fetched_at", host_of(F.col("url").cast("string")).alias("host")).withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    # no pattern has more labels than the longest
    names = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(size.labels or 1))), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    names = F.when(F.col("host").isNull(), F.array(F.lit(None).cast("string"))).when(F.contains("host", F.lit(":")), F.array("host")).otherwise(names)
    tried = rows.select("*", F.explode_outer(names).alias("pattern"))
    if size.n <= BROADCAST_ROWS and (size.bytes or 0) <= BROADCAST_BYTES:
        tried, spans = tried.withColumn("salt", F.lit(0)), F.broadcast(spans.withColumn("salt", F.lit(0)))
    else:
        tried, spans = tried.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")), spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    inside = (tried.pattern == F.col("s.pattern")) & (tried.salt == F.col("s.salt")) & (tried.fetched_at >= F.col("s.since")) & (F.col("s.until").isNull() | (tried.fetched_at < F.col("s.until")))
    met = tried.join(spans.alias("s"), inside, "left")
    best = F.min(F.struct(
        F.coalesce(-F.length("s.pattern"), F.lit(1)).alias("size"), (F.col("s.action") != "block").alias("later"),
        F.col("s.list").alias("list"), F.col("s.pattern").alias("pattern"), F.col("s.action").alias("action"), F.col("s.since").alias("since"),
    ))
    decided = met.groupBy("row", tried.page_id, tried.url, tried.fetched_at, tried.host).agg(best.alias("e"))
    return decided.select("page_id", "url", "fetched_at", "host", F.col("e.list").alias("list"), F.col("e.pattern").alias("pattern"), F.coalesce("e.action", F.lit("none")).alias("action"), F.col("e.since").alias("since"))


def page_captures(pages: DataFrame) -> DataFrame:
    """`pages` has no times, so each page gets one from its number: hours of the year 2024."""
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 37, F.lit(8784)) * 3600).alias("fetched_at"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Dated entries made from the pages' own hosts by their length and first letter, and two fixed lists.

    A host with a length divisible by three is blocked from February on and taken back in August; one
    with a length divisible by four is blocked from May on; hosts that begin with `m.` are allowed
    from June on. The domains example.org and adult-x.example.net are blocked from March and April on.
    """
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).where("pattern is not null").distinct()
    day = lambda s: F.to_timestamp(F.lit(s))
    none = F.lit(None).cast("struct<list:string,action:string,listed_at:timestamp>")
    entry = lambda name, action, at: F.struct(F.lit(name).alias("list"), F.lit(action).alias("action"), day(at).alias("listed_at"))
    n = F.length("pattern")
    made = F.array(
        F.when(n % 3 == 0, entry("spam", "block", "2024-02-01")).otherwise(none),
        F.when(n % 3 == 0, entry("spam", "remove", "2024-08-01")).otherwise(none),
        F.when(n % 4 == 0, entry("abuse", "block", "2024-05-01")).otherwise(none),
        F.when(F.col("pattern").startswith("m."), entry("trusted", "allow", "2024-06-01")).otherwise(none),
    )
    own = hosts.select("pattern", F.explode(made).alias("e")).where("e is not null").select("e.list", "pattern", "e.action", "e.listed_at")
    fixed = pages.sparkSession.range(1, numPartitions=1).select(
        F.inline(F.array(
            F.struct(F.lit("domains").alias("list"), F.lit("example.org").alias("pattern"), F.lit("block").alias("action"), day("2024-03-01").alias("listed_at")),
            F.struct(F.lit("domains").alias("list"), F.lit("adult-x.example.net").alias("pattern"), F.lit("block").alias("action"), day("2024-04-01").alias("listed_at")),
        ))
    )
    return own.unionByName(fixed)


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page of `pages` with the list entry that decides about it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = decide(page_captures(pages), page_entries(pages))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("page_id", "host", shown("fetched_at"), "list", "pattern", "action", shown("since"))


ORACLE = r"""
WITH pages_at AS (
  SELECT page_id, url,
         make_timestamp((1704067200 + (page_id * 37 % 8784) * 3600) * 1000000) AS fetched_at,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]+)', 1)), '\.$|[\[\]]', '', 'g'), '') AS host
  FROM pages),
hosts AS (SELECT DISTINCT host AS pattern FROM pages_at WHERE host IS NOT NULL),
entries AS (
  SELECT 'spam' AS list, pattern, 'block' AS action, TIMESTAMP '2024-02-01' AS listed_at FROM hosts WHERE length(pattern) % 3 = 0
  UNION ALL SELECT 'spam', pattern, 'remove', TIMESTAMP '2024-08-01' FROM hosts WHERE length(pattern) % 3 = 0
  UNION ALL SELECT 'abuse', pattern, 'block', TIMESTAMP '2024-05-01' FROM hosts WHERE length(pattern) % 4 = 0
  UNION ALL SELECT 'trusted', pattern, 'allow', TIMESTAMP '2024-06-01' FROM hosts WHERE pattern LIKE 'm.%'
  UNION ALL SELECT 'domains', 'example.org', 'block', TIMESTAMP '2024-03-01'
  UNION ALL SELECT 'domains', 'adult-x.example.net', 'block', TIMESTAMP '2024-04-01'),
spans AS (
  SELECT *, lead(listed_at) OVER (PARTITION BY list, pattern ORDER BY listed_at) AS until FROM entries),
met AS (
  SELECT p.page_id, p.host, p.fetched_at, s.list, s.pattern, s.action, s.listed_at AS since,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(s.pattern) DESC NULLS LAST, s.action DESC, s.list) AS k
  FROM pages_at p LEFT JOIN spans s
    ON s.action IN ('block', 'allow') AND (p.host = s.pattern OR (p.host NOT LIKE '%:%' AND ends_with(p.host, '.' || s.pattern)))
   AND p.fetched_at >= s.listed_at AND (s.until IS NULL OR p.fetched_at < s.until))
SELECT page_id, host, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, list, pattern, coalesce(action, 'none') AS action,
       strftime(since, '%Y-%m-%d %H:%M:%S') AS since
FROM met WHERE k = 1
"""
