"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm import alignment, automaton, contamination, dedup, extraction, language, licenses, neighbours, packing, quality, runs, secrets, sharding
from webstrata.sources.shared import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is heavy row by row."""
    return spread(_table(spark, sf_dir, name))


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_dealt(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.judge_documents(_dealt(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return verdicts.withColumn("score", F.round("score", 6))


def op3_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summarize_secrets(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op4_bayes_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(_dealt(spark, sf_dir, "documents"))


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.encode_documents(_dealt(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _dealt(spark, sf_dir, "documents")
    guesses = language.identify_languages(docs, language.learn_samples(docs))
    return guesses.select("doc_id", language.held_out(guesses["doc_id"]).alias("held_out"), "lang_pred", "score")


def op7_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _dealt(spark, sf_dir, "documents")
    return licenses.scan_licenses(docs, licenses.train(licenses.background(docs)))


def op8_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op9_tag_path_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_pages(_dealt(spark, sf_dir, "pages"))


def op10_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"))


def op11_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.summarize(contamination.find_contamination(_dealt(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op12_merge_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.summarize(_dealt(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_baier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.summarize(runs.detect_runs(runs.with_periods(_dealt(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    import corpus_pipeline

    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from webstrata.llm.sql import SQL

    return dict(SQL)
