"""Fixtures of the subpackage's tests: small tables with awkward rows."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                     StructField("source", StringType()), StructField("n_chars", LongType())])


def frame(spark, rows, *extra):
    """Documents from (doc_id, text[, lang[, source]]); ``extra`` names further columns, filled with clashing values."""
    full = [((*r, None, None, None)[:4] + (len(r[1]) if r[1] is not None else None,) + ("x",) * len(extra)) for r in rows]
    return spark.createDataFrame(full, StructType([*SCHEMA.fields, *(StructField(e, StringType()) for e in extra)])).repartition(3)


def prose(seed, words=80, vocabulary=400, prefix="w"):
    rng = random.Random(seed)
    return " ".join(f"{prefix}{rng.randrange(vocabulary)}" for _ in range(words))


AWKWARD = [(None, "no id here", "en", "a"), (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "de", "b"), (4, "same text", "en", "a"),
           (4, "same text", "en", "a"), (5, "same text", None, None), (6, "ünïcode ßtraße 漢字", "de", "b"), (7, "word " * 30_000, "en", "a"),
           (8, "x" * 200_000, "en", "c"), (9, None, "en", "c"), (None, None, None, None)]
