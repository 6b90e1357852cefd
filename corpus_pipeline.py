"""The corpus pipeline: documents to packed training batches, in stages that each call one operator of quirelight.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirelight.llm import common, packing, quality, simhash, suffix, templates


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their host's boilerplate lines."""
    return quality.clean(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template recurs across documents."""
    return templates.without_templates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_first(docs)


#: Bytes of the repeats that are cut: shorter than passages of 50 words (about 250 bytes), longer than a sentence.
REPEAT_BYTES = 200


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the long byte strings that repeat."""
    return suffix.remove_repeats(docs, REPEAT_BYTES)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of all documents in length buckets and batches."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: Suffix sorting and length buckets are not SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = common.materialize(docs, f"stage-{name}")
    return docs
