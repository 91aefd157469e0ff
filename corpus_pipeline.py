"""The corpus pipeline: quality rules, language, near-duplicates, secrets, packing.

Each stage takes what the stage before it kept, as a table of ``documents``; the last gives pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm import dedup, language, packing, quality, secrets
from webstrata.llm.common import discard, materialize

#: A text is in none of the learned languages if even the best one parses it letter by letter.
MAX_PHRASE_RATE = 0.6


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rule or score under the threshold."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those that fit none of the learned languages."""
    return language.keep_known(docs, language.learn_samples(docs), MAX_PHRASE_RATE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one with the smallest id.

    Repeated rows are one document; rows without an id, or with an id that other texts have too, are
    documents like any other.
    """
    return dedup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; n_chars follows the text."""
    marked = secrets.find_secrets(docs.select(F.struct("*").alias("row"), "text"), id_col="row", text=True)
    clean = marked.withColumn("spans", F.array_sort(F.concat("base", "added"))).select("doc_id", secrets.redacted("text", "spans").alias("clean"), (F.size("spans") > 0).alias("changed"))
    columns = []
    for c in docs.columns:
        old = F.col("doc_id").getField(c)
        if c == "text":
            columns.append(F.when(F.col("changed"), F.col("clean")).otherwise(old).alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("changed"), F.length("clean").cast(docs.schema[c].dataType)).otherwise(old).alias(c))
        else:
            columns.append(old.alias(c))
    return clean.select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("packing", pack),
]

#: No SQL: language models, suffix automata and BPE can't be expressed in it. Tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's docs.

    A stage's table is deleted when the next one's is written, but for the last, which packing reads.
    Very long texts pass every stage whole; a stage's memory goes with its longest text.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-").lower())
            if before is not None:
                discard(before)
            before = docs
    return docs
