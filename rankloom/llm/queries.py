"""The operators' queries over whole tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, langid, licenses, quality_classifier, quality_rules, sharding, simhash, toxicity, url_filters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file of the package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op1_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.op3_rows(table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.op4_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op5_digest(bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path()))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op6_rows(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op7_rows(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op8_digest(decontam.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op10_rows(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_rules, op2_toxicity, op3_url_filters, op4_quality_classifier, op5_bpe,
    op6_langid, op7_licenses, op8_decontamination, op9_simhash, op10_sharding,
)}

ORACLE_SQL: dict[str, str] = {"op3_url_filters": url_filters.ORACLE, "op8_decontamination": decontam.ORACLE}
