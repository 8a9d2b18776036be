"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidepool.llm import (bpe, centroids, chat, decontamination, exact_dedup, language, mixing, near_dedup, pii, quality, repeats,
                          sharding, whitening)
from tidepool.llm.common import documents
from tidepool.llm.oracle import ORACLE as _SQL


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.predict(docs, language.train(docs))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), *corpus_pipeline.tokenizer())


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir), words=4)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_language": op1_language,
    "op2_mixing": op2_mixing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sharding": op4_sharding,
    "op5_chat": op5_chat,
    "op6_quality": op6_quality,
    "op7_pii": op7_pii,
    "op8_repeats": op8_repeats,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_near_dedup": op10_near_dedup,
    "op11_decontamination": op11_decontamination,
    "op12_whitening": op12_whitening,
    "op13_centroids": op13_centroids,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {k: v for k, v in _SQL.items() if k in QUERIES}
