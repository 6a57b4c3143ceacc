"""A training corpus in five stages: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written
as Parquet and read again as the next one's docs. All but the last return the columns of
docs. ORACLE_SQL is None: the classifier, the fingerprints, the edit-distance search and
the permutation have no SQL form; the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finwake.llm import decontamination, minmax, mixing, quality, sharding, simhash
from finwake.llm.store import free_names, materialise, with_rows

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Labels of documents that are gone play no part."""
    columns, labels = docs.columns, spark.read.parquet(f"{sf_dir}/labels.parquet")
    (row,) = free_names(columns, "_row")
    docs = with_rows(docs, "doc_id", row, "stage-rows")
    scored = materialise(quality.score_quality(docs, labels, row=row), "stage-quality")
    bad = scored.filter(F.col("score") < quality.CUT).select(row)
    return docs.join(bad, row, "left_anti").select(*columns)


def _without(docs: DataFrame, groups: DataFrame, row: str) -> DataFrame:
    """docs without the members of ``groups`` that are not their component's smallest row."""
    drop = groups.filter(F.col(row) != F.col("component_id")).select(row)
    return docs.join(drop, row, "left_anti")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one with the smallest id.

    Groups are, first, fingerprints linked at two bits (texts without any word share
    fingerprint zero) and then, of what stays, texts whose 5-word shingles have a Jaccard
    similarity of 0.8 or more. Rows that share an id, or have none, are decided one by one.
    """
    columns = docs.columns
    (row,) = free_names(columns, "_row")
    docs = with_rows(docs, "doc_id", row, "stage-rows")
    first = materialise(_without(docs, simhash.near_groups(docs.select(row, "text"), row), row), "stage-near")
    near = minmax.similar_groups(first.select(row, "text"), row, size=5, words="unicode")
    return _without(first, near, row).select(*columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources meet their target weights; same columns, rows in global random order."""
    return mixing.mix(docs).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard (0 to 7) and slot."""
    return sharding.shuffle_into_shards(docs, 8).drop("position")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
