"""The corpus pipeline: documents in, packed training pieces out.

Each stage reads what its predecessor kept, applies one corpus operator and drops what that rejects; the
columns stay those of ``documents`` until the last stage packs the token pieces. Every stage's result is a Parquet
table in the shared folder, so a lost executor costs at most the tasks of one stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenetdq.llm import decontaminate, exact_dedup, lang_id, near_dedup, packing
from tenetdq.llm.common import settled, table
from tenetdq.llm.queries import BYTE_BPE


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a learned language is recognised; null, letterless and unknown text goes."""
    return lang_id.keep_accepted(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space."""
    return exact_dedup.keep_owners(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five-word shingles, similarity 0.8)."""
    return near_dedup.keep_one(docs, shingle=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised or not."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents, placed in sequences of at most 2048 tokens."""
    return packing.pack(packing.cut_pieces(docs, BYTE_BPE, end_id=0, capacity=2048, with_ids=False), 2048)


STAGES = [("language_id", language_id), ("exact_dedup", exact_duplicates), ("minhash_near_dedup", near_duplicates),
          ("benchmark_decontamination", decontamination), ("best_fit_packing", best_fit)]

# Language decisions and tokens are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
