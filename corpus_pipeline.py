"""From raw documents to token ids: quality rules, exact and near deduplication,
mixing of the sources, byte-level BPE.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame`` over all that the
stage before it kept; all but the last return the columns of ``docs``.  ``run``
writes every stage's result to the shared folder and reads it back, so a lost
executor costs at most the running stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import bpe, exact_dedup, mixing, near_dedup, quality
from tidepool.llm.common import documents, staged

RANKS = "byte_bpe_50k.tiktoken"

#: Neither the learned references nor signatures can be put in SQL; tests check the
#: stages against brute force.
ORACLE_SQL = None


def tokenizer() -> tuple[str, str]:
    """Place of the rank file and the pre-splitting pattern of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and stand near their language's reference."""
    return quality.keep_rows(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup.keep_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at a similarity of 0.8, the one with the smallest doc_id."""
    return near_dedup.keep_rows(docs, words=5, threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents left out, taken once, or repeated."""
    return mixing.take_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the decoded bytes."""
    return bpe.round_trip(docs, *tokenizer(), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
