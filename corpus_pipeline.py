"""From raw documents to packed sequences: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commitgauge.llm.common import read_table, stored
from commitgauge.llm.line_chunks import deduplicated_documents
from commitgauge.llm.minhash_dedup import near_duplicates
from commitgauge.llm.mixing import mixed_documents
from commitgauge.llm.packing import pack
from commitgauge.llm.quality_rules import cleaned_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without their failing lines."""
    return cleaned_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier in the corpus; those left without a word go."""
    return deduplicated_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    kept = near_duplicates(docs).filter("kept").select("doc_id").distinct()
    known = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi")
    return known.dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id is null")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, repeated documents as repeated rows."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 1,024 tokens."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixture),
    ("packing", packing),
]

#: Shingle links over components, hashes of signatures and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
