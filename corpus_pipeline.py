"""Corpus pipeline: five stages from raw documents to a mix, each working on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scoutgrid.llm import decontaminate, jaccard_join, mixing, quality_rules, secret_scan
from scoutgrid.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet all quality rules.

    Null, empty and blank texts fail them; repeated rows are judged alike; an empty table gives none; other columns pass through.
    """
    return quality_rules.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles: the one with the smallest key.

    Of repeated rows one stays; texts without a word link with nothing; an empty table gives none; other columns pass through.
    """
    return jaccard_join.deduplicated(docs, k=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts have none and stay; without benchmark items all stay; an empty table gives none; other columns pass through.
    """
    return decontaminate.clean_only(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark and ``n_chars`` counted anew.

    Null texts stay null; repeated rows change alike; an empty table gives none; other columns pass through.
    """
    return secret_scan.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with the number of words to take of each.

    Texts without a word are not taken; null sources are a source; own columns named like an added one give way; an empty table gives none.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scan", without_secrets),
    ("source mixing", mixed),
]

#: Edit distances, lexing and block selection are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; what a stage gives is kept before the next one reads it, so that each runs once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
