"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import scratch_dir

#: A word: a run of anything but ASCII white space (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def staged(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; ``codec``, if not the session's.

    Cuts the lineage in a way that survives lost executors, and lets several
    consumers share one evaluation.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words (``WORD``) as a long: the word starts, without building the words.

    Blanks become spaces, every other character a letter ``x`` would need a scan
    per character; splitting on blank runs is the cheapest built-in form.
    """
    clean = F.trim(F.translate(text_or_empty(text), _BLANKS, " " * len(_BLANKS)))
    return F.when(clean == "", F.lit(0)).otherwise(F.size(F.split(clean, " +"))).cast("long")
