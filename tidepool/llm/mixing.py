"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key, the MD5 of its doc_id and a seed.  Within
a source, documents are taken in key order: as many whole epochs as the source's
budget holds, then a last epoch that is cut at the exact budget, inside a
document if need be.  The cut needs the running size in key order; it is a
two-level prefix sum: a window inside (source, leading digits of the key), and a
window over the totals of those buckets.  Keys are uniform, so a hot source is
spread over all its buckets.

Targets share ``share`` times all sizes by weight; a target stops at
``max_epochs`` times its source's size, and the excess goes to the others by
weight until none is above (water-filling, solved in closed form over the sources
in order of size by weight).

Defined results: a null text has size 0; documents of size 0 are never taken; a
null source is a source of its own, the last in order; rows that share doc_id get
equal keys and follow each other by size; an empty table gives an empty result;
further columns of the input are ignored, or returned untouched by ``take_rows``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import n_words, staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix"
ROWS_PER_BUCKET = 20_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from one row ``source, source_size`` per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("fill", "rank")
    above = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return (sizes.withColumn("rank", F.row_number().over(order))
            .withColumn("weight", F.element_at(cycle, (F.col("rank") - 1) % len(weights) + 1))
            .withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
            .withColumn("fill", F.col("cap") / F.col("weight"))
            .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
            .withColumn("free", F.col("budget") - F.coalesce(F.sum("cap").over(above), F.lit(0.0)))
            .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(above), F.lit(0.0)))
            # the first source, in order of fill, that the water level does not cover sets the level
            .withColumn("level", F.min(F.when(F.col("free") <= F.col("fill") * F.col("open"), F.struct(
                "fill", "rank", (F.col("free") / F.col("open")).alias("at")))).over(everything)["at"])
            .select("source", "source_size",
                    F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
        seed: str = SEED, text: str = "text") -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, key`` for every document."""
    rows = staged(docs.select(
        "doc_id", "source", F.coalesce(n_words(F.col(text)), F.lit(0).cast("long")).alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed))).alias("key")), "mix")
    digits = min(4, max(1, math.ceil(math.log(max(1, rows.count()) / ROWS_PER_BUCKET + 1, 16))))
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    buckets = (totals.withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0).cast("long")))
               .join(goals.withColumnRenamed("source", "g_source"), F.col("source").eqNullSafe(F.col("g_source")))
               .select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "before", "source_size", "target"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    joined = placed.join(buckets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("before") - F.col("start")
    last = F.least("size", F.greatest(F.lit(0), rest))
    return joined.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"),
                         "source", "key")


def take_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, all columns: each row as often as its taken words fill its
    size, where a last part counts as a whole document from one half on."""
    taken = staged(mix(docs, **options), "taken").filter("taken > 0").select(
        F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("size").alias("t_size"), "taken")
    # Rows that repeat all three are alike for the mix: their copies are shared out in the order of their texts' digests.
    alike = Window.partitionBy("t_id", "t_source", "t_size").orderBy(F.desc("taken"))
    taken = taken.withColumn("t_nth", F.row_number().over(alike))
    row = docs.select(F.col("doc_id").alias("r_id"), F.col("source").alias("r_source"),
                      F.coalesce(n_words(F.col(options.get("text", "text"))), F.lit(0).cast("long")).alias("r_size"),
                      F.xxhash64(F.col(options.get("text", "text"))).alias("r_digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = row.withColumn("r_nth", F.row_number().over(Window.partitionBy("r_id", "r_source", "r_size").orderBy("r_digest")))
    same = (F.col("r_id").eqNullSafe(F.col("t_id")) & F.col("r_source").eqNullSafe(F.col("t_source"))
            & (F.col("r_size") == F.col("t_size")) & (F.col("r_nth") == F.col("t_nth")))
    copies = F.floor(F.col("taken") / F.col("t_size") + 0.5).cast("int")
    return (row.join(taken.hint("merge"), same).withColumn("row", F.explode(F.array_repeat("row", copies))).select("row.*"))
