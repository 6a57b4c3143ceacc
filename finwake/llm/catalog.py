"""Queries of this subpackage over the test tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from finwake.llm import centroids, decontamination, exact_dedup, html_text, lm_scoring, minmax, mixing, quality, sharding, simhash, suffix_dedup, toxicity, variants


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contaminated document with the items it holds; clean documents have no row."""
    return decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(_read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.decisions(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "text", "copy_no", "copies", "shuffle_key")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(_read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_read(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.digest(_read(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.decisions(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(_read(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_read(spark, sf_dir, "documents"))


def op13_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.digest(_read(spark, sf_dir, "documents"))


OPERATORS = (
    op1_decontamination,
    op2_sharding,
    op3_suffix_dedup,
    op4_toxicity,
    op5_exact_dedup,
    op6_mixing,
    op7_lm_scoring,
    op8_simhash,
    op9_html_text,
    op10_quality,
    op11_centroids,
    op12_spelling_variants,
    op13_minmax,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact_dedup.ORACLE_SQL, "op6_mixing": mixing.ORACLE_SQL, "op11_centroids": centroids.ORACLE_SQL, "op13_minmax": minmax.ORACLE_SQL}
