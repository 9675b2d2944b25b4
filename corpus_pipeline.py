"""From raw documents to token ids: toxicity filter, near-duplicates, secrets, mixture, tokens.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last return
the columns of ``documents``. Stage functions take (spark, docs, folder of the given tables).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from digitscope.llm import bpe, mixing, queries, secret_scan, simhash, toxicity
from digitscope.llm.shared import stored

# Part of the tokens that the mixture takes.
MIXED = 0.9


def toxic_out(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the classifier learns from the labelled ones among them."""
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col("text").alias("text"))
    return toxicity.score(whole, model).where("score < 0.5").select("d.*")


def near_duplicates_out(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: four-word shingles, at most four differing bits."""
    return simhash.representatives(docs, words=4, radius=4)


def secrets_out(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, their secrets masked; ``n_chars`` follows the text."""
    masked = secret_scan.masked(docs)
    length = F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", length)


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents taken in one epoch to fill nine tenths of all words by the weights of domains, languages and sources."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), "doc_id", "text", "lang", "source", queries.domain(F.col("source")).alias("domain"))
    return mixing.mix(whole, queries.WEIGHTS, ("domain", "lang", "source"), queries.words(F.col("text")), MIXED).select("d.*")


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document: ``doc_id, lang, source, n_tokens, ids``."""
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), queries.RANKS, public_tokenizers.PATTERN)
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxic_out),
    ("near-duplicates", near_duplicates_out),
    ("secrets", secrets_out),
    ("mixture", mixture),
    ("tokens", tokens),
]

# A trained classifier, XXH64 fingerprints and BPE merges cannot be said in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
