"""From raw documents to token ids: five stages, each applied to all that the one before kept.

To the near-duplicate stage every row is a document, whatever its doc_id. It links texts whose sets of
shingles of five words have a Jaccard similarity of 0.8 or more. Candidates are texts of which any of
four fingerprints differ in four or fewer of 64 bits, and texts that share a MinHash band; each is
verified (`diurna/llm/copies.py`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diurna.llm import bpe, copies, decontam, pii, quality, store

WORDS, RADIUS, TABLES = 5, 4, 4


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose lines are mostly good; all of them if the labels teach no difference."""
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model is None:
        return docs
    return quality.score(docs, model, keep=True).where(F.col("score") >= quality.GOOD).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of the smallest doc_id, ids that are null last."""
    found = copies.groups(docs, WORDS, RADIUS, TABLES)
    stays = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"))).alias("b")).select("b._doc", "b._text")
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_text"))
    kept = docs.join(stays, own, "left_semi")
    # rows equal in doc_id and text are told apart by the other columns
    row = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source", "lang"))
    return kept.withColumn("_row", row).where("_row = 1").select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of `benchmark`."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets; n_chars follows the text."""
    out = pii.replace(docs, pii.KEY)
    return out.withColumn("n_chars", F.when(F.col("_pii_entities") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text: number of ids and digests of both."""
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode_and_decode(docs, path, P.PATTERN))


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmarks),
    ("PII surrogates", with_surrogates),
    ("byte-level BPE", token_ids),
]

#: Classifier, trees and encoding cannot be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
