"""The registered query of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotraining, decontaminate, digest_index, html_text, language, lines, mixing, negatives, quality_rules, resampling, secrets, simhash, suffixes
from .common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs)).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "runs")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return cotraining.score(docs, cotraining.train(docs, read(spark, sf_dir, "labels")))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.report(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_suffix_dedup, op3_line_dedup, op4_simhash, op5_mix_sources, op6_language_id, op7_secret_scan, op8_cotraining, op9_html_text, op10_decontaminate, op11_resample, op12_exact_dedup, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_mix_sources": mixing.ORACLE.format(docs="documents"),
        "op11_resample": resampling.ORACLE.format(docs="documents", target="benchmark"),
        "op12_exact_dedup": digest_index.ORACLE.format(docs="documents"),
        "op13_hard_negatives": negatives.ORACLE.format(vectors="embeddings"),
    }
