"""The corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import exact, minhash, packing, rules, suffix
from siftwell.llm.common import written

#: Five-word shingles and a similarity of 0.8; a pair there shares none of 32 bands with a chance of 5e-8.
NEAR = minhash.Settings(words=5, percent=80, bands=32, rows=4, floor=0.55)
#: Repeated passages are cut from this many bytes on, about thirty words: shorter ones may be chance or custom.
PASSAGE_BYTES = 200


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules take for good; the rules are learned from ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.keep_good(docs, rules.fit_quality(docs, labels))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return exact.kept_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near duplicates."""
    return minhash.nearly_unique(docs, NEAR)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that one with a smaller id holds."""
    return suffix.without_repeats(docs, PASSAGE_BYTES)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("suffix dedup", suffix_stage),
    ("packing", packing_stage),
]
#: SQL has no rules, components, suffixes or packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
