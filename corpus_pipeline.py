"""The corpus pipeline: from raw documents to packed training sequences.

Each stage works on all that its predecessor kept, written as Parquet and read again.  Null texts
count as empty and go with the first stage; repeated rows are copies of each other, of which one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricemap.llm import decontamination, langid, packing, repetition, simhash
from pricemap.llm.store import drop, saved, work_tables


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the fused evidence tells."""
    return langid.keep_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the suffix-array repetition limits keep."""
    return repetition.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies (five-word shingles, similarity 0.8 or more)."""
    return simhash.one_of_each_group(docs, n=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs."""
    return decontamination.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all token pieces in sequences of at most 2048 tokens and 64 documents."""
    return packing.pack_documents(docs, packing.Capacity(tokens=2048, documents=64))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Tokenising and the trained language models can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with work_tables() as keep:
            before, docs = docs, saved(stage(spark, docs, sf_dir), f"stage-{name}")
            keep.append(docs)
        if k:
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
