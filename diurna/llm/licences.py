"""Licence scan by diagonal voting.

1. All rolling word pairs of every text, and its rolling runs of four words, are hashed and joined
   to the places of the same runs in the templates.
2. A hit at word p of a text and word o of a template lies on diagonal p - o. Hits are counted by
   text, template and diagonal.
3. Diagonals of one text and template that are at most GAP apart are merged: words put in or left
   out shift the rest of a passage to the next diagonal.
4. A merged span is verified by its words: the template's words that stand at their places, on any
   of its diagonals, must be COVER of the template; a phrase must stand word for word.

The templates are a parameter of fixed size, so they are broadcast, and the texts are not shuffled;
only hits and one row for each text are.

Defined cases: an empty table gives an empty result; very long texts are scanned whole; a null or empty text has no words and no place; repeated rows give repeated rows;
places that overlap all count; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .words import ascii_lower, rolling, small

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose every place counts: the contract's own. Fixed values.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Longer passages; COVER of their words in place is enough.
PASSAGES = (
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("gnu affero general public license as published by the free software foundation", "agpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
)
COVER = 0.9
#: A span needs hits on at least this share of its template's runs.
VOTES = 0.25
GAP = 3
SHORT, LONG = 2, 4
#: The hash of a row that stands for a text itself.
SELF = -1


def templates(spark: SparkSession, phrases=PHRASES, passages=PASSAGES) -> DataFrame:
    """(hash, template, offset, length, label, exact, words) for every run of every template."""
    rows = [(p, label, True) for p, label in phrases] + [(p, label, False) for p, label in passages]
    for text, _, exact in rows:
        if len(text.split()) < (SHORT if exact else LONG):
            raise ValueError(f"too short for a template: {text!r}")
    listed = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(t).alias("text"), F.lit(b).alias("label"), F.lit(e).alias("exact")) for i, (t, b, e) in enumerate(rows)))
    table = spark.range(1, numPartitions=1).select(F.explode(listed).alias("t")).select("t.*")
    table = table.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("length", F.size("words"))
    runs = table.select("*", F.posexplode(F.when(F.col("exact"), rolling(F.col("words"), SHORT)).otherwise(rolling(F.col("words"), LONG))).alias("offset", "hash"))
    self_row = spark.range(1, numPartitions=1).select(
        F.lit(SELF).cast("long").alias("hash"), F.lit(-1).alias("template"), F.lit(0).alias("offset"), F.lit(0).alias("length"),
        F.lit("").alias("label"), F.lit(False).alias("exact"), F.array().cast("array<string>").alias("words"),
    )
    return runs.select("hash", "template", "offset", "length", "label", "exact", "words").unionByName(self_row)


def hits(docs: DataFrame, table: DataFrame, rows: int) -> DataFrame:
    """One row for each run of a text that is in a template, and one for the text itself (template -1)."""
    low = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("own"))
    own = F.col("own")
    texts = texts.select("doc_id", "row", "own", F.concat(rolling(own, SHORT), rolling(own, LONG), F.array(F.lit(SELF).cast("long"))).alias("hashes"))
    runs = texts.select("doc_id", "row", "own", F.posexplode_outer("hashes").alias("at", "hash"))
    short_runs = F.greatest(F.size("own") - (SHORT - 1), F.lit(0))
    found = runs.join(small(table, rows), "hash")
    # runs of four words come after the pairs
    start = F.when(F.col("exact"), F.col("at")).otherwise(F.col("at") - short_runs) - F.col("offset")
    kind = (F.col("template") < 0) | (F.col("exact") == (F.col("at") < short_runs))
    found = found.where(kind).select("doc_id", "row", "template", "length", "label", "exact", "words", "own", start.alias("diagonal"))
    inside = F.slice("own", F.greatest(F.col("diagonal"), F.lit(0)) + 1, F.greatest(F.col("length") + F.least(F.col("diagonal"), F.lit(0)), F.lit(0)))
    seen = F.when(F.col("diagonal") < 0, F.concat(F.transform(F.sequence(F.lit(1), F.greatest(-F.col("diagonal"), F.lit(1))), lambda _: F.lit("")), inside)).otherwise(inside)
    return found.select(
        "doc_id", "row", "template", "label", "exact", "length", F.when(F.col("template") < 0, F.lit(0)).otherwise(F.col("diagonal")).alias("diagonal"), F.size("own").alias("n_words"), in_place(seen, F.col("words")).alias("places")
    )


def in_place(seen: Column, words: Column) -> Column:
    """Numbers of the template's words that stand at their places."""
    return F.filter(F.transform(words, lambda w, i: F.when(F.get(seen, i) == w, i)), lambda i: i.isNotNull())


def scan(docs: DataFrame, phrases=PHRASES, passages=PASSAGES) -> DataFrame:
    """Verified spans (doc_id, row, template, label, exact, first_word, last_word, cover), and for each text a row with template -1."""
    rows = sum(len(t.split()) for t, _ in (*phrases, *passages)) + 1
    voted = hits(docs, templates(docs.sparkSession, phrases, passages), rows)
    voted = voted.groupBy("doc_id", "row", "template", "label", "exact", "length", "diagonal").agg(F.count("*").alias("votes"), F.max("n_words").alias("n_words"), F.max("places").alias("places"))
    # a phrase must stand whole, so only diagonals of passages are merged
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.col("exact") | F.lag("diagonal").over(near).isNull() | (F.col("diagonal") - F.lag("diagonal").over(near) > GAP)
    spans = voted.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(near))
    spans = spans.groupBy("doc_id", "row", "template", "label", "exact", "length", "span").agg(
        F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes"), F.max("n_words").alias("n_words"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("matched"),
    )
    cover = F.when(F.col("length") == 0, 0.0).otherwise(F.col("matched") / F.greatest(F.col("length"), F.lit(1)))
    spans = spans.withColumn("cover", cover)
    verified = (F.col("template") < 0) | F.when(F.col("exact"), F.col("matched") == F.col("length")).otherwise(
        (F.col("cover") >= COVER) & (F.col("votes") >= VOTES * (F.col("length") - (LONG - 1)))
    )
    return spans.where(verified).select("doc_id", "row", "template", "label", "exact", "n_words", F.col("low").alias("first_word"), (F.col("high") + F.col("length") - 1).alias("last_word"), "cover")


def summary(spans: DataFrame) -> DataFrame:
    """One row for each text: number of words, places of phrases, labels."""
    base = F.col("exact") & (F.col("template") >= 0)
    join = lambda labels: F.array_join(F.array_sort(labels), ",")
    out = spans.groupBy("row", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        join(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        join(F.collect_set(F.when(F.col("template") >= 0, F.col("label")))).alias("labels"),
        F.max("cover").cast("double").alias("score"),
    )
    return out.drop("row")


def op9_licences(spark, sf_dir: str) -> DataFrame:
    """Licence phrases and passages in every text of `documents`."""
    return summary(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _rows(listed: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v) for v in row) + ")" for row in listed)


#: The same rows in SQL.
ORACLE = f"""
WITH t AS (SELECT *, string_split(txt, ' ') AS tw FROM (VALUES {_rows([(i, t, lab, i < len(PHRASES)) for i, (t, lab) in enumerate((*PHRASES, *PASSAGES))])}) AS v(id, txt, label, exact)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
tp AS (SELECT id, label, exact, len(tw) AS l, unnest(range(len(tw))) AS o, tw FROM t),
dp AS (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d),
hit AS (SELECT doc_id, id, label, exact, l, p - o AS diag FROM (SELECT doc_id, p, list_slice(w, p + 1, p + 2) AS g FROM dp WHERE p + 2 <= len(w)) JOIN (SELECT *, list_slice(tw, o + 1, o + 2) AS g FROM tp WHERE exact AND o + 2 <= l) USING (g)
  UNION ALL SELECT doc_id, id, label, exact, l, p - o FROM (SELECT doc_id, p, list_slice(w, p + 1, p + 4) AS g FROM dp WHERE p + 4 <= len(w)) JOIN (SELECT *, list_slice(tw, o + 1, o + 4) AS g FROM tp WHERE NOT exact AND o + 4 <= l) USING (g)),
vote AS (SELECT doc_id, id, label, exact, l, diag, count(*) AS votes FROM hit GROUP BY ALL),
mark AS (SELECT *, CASE WHEN exact OR lag(diag) OVER (PARTITION BY doc_id, id ORDER BY diag) IS NULL OR diag - lag(diag) OVER (PARTITION BY doc_id, id ORDER BY diag) > {GAP} THEN 1 ELSE 0 END AS fresh FROM vote),
span AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, id ORDER BY diag) AS s FROM mark),
place AS (SELECT x.doc_id, x.id, x.s, count(DISTINCT tp.o) AS matched FROM span x JOIN tp ON tp.id = x.id JOIN d ON d.doc_id = x.doc_id WHERE x.diag + tp.o >= 0 AND d.w[x.diag + tp.o + 1] = tp.tw[tp.o + 1] GROUP BY 1, 2, 3),
spans AS (SELECT doc_id, id, label, exact, l, s, min(diag) AS low, sum(votes) AS votes FROM span GROUP BY 1, 2, 3, 4, 5, 6),
good AS (SELECT *, matched / l AS cover FROM spans JOIN place USING (doc_id, id, s) WHERE CASE WHEN exact THEN matched = l ELSE matched / l >= {COVER} AND votes >= {VOTES} * (l - {LONG - 1}) END)
SELECT d.doc_id, CAST(any_value(len(d.w)) AS BIGINT) AS n_words, count(*) FILTER (exact) AS n_base, CAST(min(low) FILTER (exact) AS BIGINT) AS first_word, CAST(max(low) FILTER (exact) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (exact)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels, coalesce(max(cover), 0.0)::DOUBLE AS score
FROM d LEFT JOIN good g ON g.doc_id = d.doc_id GROUP BY d.doc_id
"""
