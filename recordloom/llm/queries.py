"""Queries of the training-data operators, by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import decontam, licenses, linededup, lm, neardup, oracle, packing, pii, quality, toxicity, urls
from recordloom.llm.common import table


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_model_scores(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", F.col("_n_gone").alias("n_removed_lines"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file, which is installed beside the engine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Key of the registered query; a deployment passes its own secret.
PII_KEY = "example-key"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return done.select("doc_id", "text", F.size("_entities").cast("long").alias("n_entities"), *_kind_counts())


def _kind_counts() -> list:
    def count(kind: str):
        return F.size(F.filter("_entities", lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    return [count(kind) for kind in pii.KINDS]


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_license_scans, op2_toxicity, op3_quality_rules, op4_simhash_near_dedup, op5_lm_scoring, op6_benchmark_decontamination, op7_pii, op8_best_fit_packing, op9_url_filters, op10_line_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
