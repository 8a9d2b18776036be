"""Minimax contiguous sharding of documents, in DataFrame operations only.

Equal texts form an atomic group; groups stand in the order of their digests.
Among all ways to cut that order into ``shards`` contiguous runs, the one whose
largest run has the fewest bytes is wanted.  Its capacity is searched by bisection
between the obvious bounds; a capacity is feasible if greedy filling (each shard
takes groups while they fit) needs no more than ``shards`` shards.

A greedy step is a lookup, the largest prefix sum that is at most ``x``, in a table
of the groups' prefix sums that is stored in order.  A round tests many capacities
at once: step by step, one aggregation with one conditional maximum per capacity.
A filter keeps a step to the row groups near its lookups: no group is larger than
the largest, so a prefix sum lies at most that far below.  Only the capacities and
the cuts come to the driver.

Prefix sums and slots are two-level: a window inside a bucket, and a window over
the bucket totals.  Buckets are leading digits of digests, so they are even; the
copies of one text are numbered in buckets of their doc_ids' digests.

Defined results: a null text has no bytes and groups with empty texts; rows that
share doc_id and text are numbered in any order; an empty table gives an empty
result; further columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import staged, text_or_empty

SHARDS = 8
CAPACITIES = 32
ROWS_PER_BUCKET = 20_000


def _running(df: DataFrame, parts: list[str], bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows before a row, in order of bucket and ``order`` within ``parts``."""
    df = df.withColumn("_v", value)
    totals = df.groupBy(*parts, bucket).agg(F.sum("_v").alias("_total"))
    prior = Window.unboundedPreceding
    across = Window.partitionBy(*parts).orderBy(bucket).rowsBetween(prior, -1)
    zero = F.lit(0).cast("long")
    before = totals.select(*[F.col(c).alias(f"_{c}") for c in (*parts, bucket)],
                           F.coalesce(F.sum("_total").over(across), zero).alias("_before"))
    inside = Window.partitionBy(*parts, bucket).orderBy(*order).rowsBetween(prior, -1)
    same = [F.col(c) == F.col(f"_{c}") for c in (*parts, bucket)]
    return (df.withColumn("_start", F.coalesce(F.sum("_v").over(inside), zero)).join(before, same)
            .withColumn(name, F.col("_before") + F.col("_start"))
            .drop("_v", "_start", "_before", *[f"_{c}" for c in (*parts, bucket)]))


def _digits(rows: int) -> int:
    return min(4, max(1, math.ceil(math.log(rows / ROWS_PER_BUCKET + 1, 16))))


def _greedy(ends: DataFrame, capacities: list[int], shards: int, largest: int) -> list[list[int]]:
    """For each capacity, the prefix sums after each greedy step but the last."""
    at, cuts = [0] * len(capacities), [[] for _ in capacities]
    for _ in range(shards - 1):
        limit = [a + c for a, c in zip(at, capacities)]
        near = F.col("end").between(min(limit) - largest, max(limit))
        found = ends.filter(near).agg(*[F.max(F.when(F.col("end") <= x, F.col("end"))).alias(f"c{k}")
                                        for k, x in enumerate(limit)]).first()
        at = [max(a, found[k] or 0) for k, a in enumerate(at)]
        for k, a in enumerate(at):
            cuts[k].append(a)
    return cuts


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int = SHARDS) -> list[int]:
    """Prefix sums at which the runs of the best contiguous partition end, but the last.

    ``ends`` has the column ``end``, the prefix sums of the group sizes."""
    if not total:
        return [0] * (shards - 1)
    low = max(-(-total // shards), largest) - 1   # low: infeasible or below the bound
    high = -(-total // shards) + largest          # feasible: a step leaves less than one group free
    best = None
    while high - low > 1 or best is None:
        span = high - low
        tries = sorted({low + max(1, span * k // CAPACITIES) for k in range(1, CAPACITIES + 1)})
        done = _greedy(ends, tries, shards, largest)
        fits = [k for k, cuts in enumerate(done) if total - (cuts[-1] if cuts else 0) <= tries[k]]
        best, high = done[fits[0]], tries[fits[0]]
        low = tries[fits[0] - 1] if fits[0] else low
    return best


def assign(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every document."""
    body = text_or_empty(text)
    rows = staged(docs.select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.sha2(body, 256).alias("digest"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("id_key")), "sizes")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    n, total, largest = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)),
                                   F.coalesce(F.max("bytes"), F.lit(0))).first()
    groups = groups.withColumn("bucket", F.substring("digest", 1, _digits(n)))
    groups = _running(groups, [], "bucket", ["digest"], F.col("bytes"), "start")
    ends = staged(groups.select("digest", (F.col("start") + F.col("bytes")).alias("end"))
                  .repartitionByRange("end").sortWithinPartitions("end"), "ends")
    cuts = minimax_cuts(ends, total, largest, shards)
    shard = sum((F.when(F.col("end") > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    placed = staged(ends.select(F.col("digest").alias("g_digest"), shard.cast("int").alias("shard")), "placed")
    out = rows.join(placed, F.col("digest") == F.col("g_digest")).drop("g_digest")
    out = out.withColumn("bucket", F.substring("id_key", 1, _digits(rows.count())))
    out = staged(out, "sharded")  # the digests' partitioning ends here: slots are counted over even buckets
    out = _running(out, ["shard"], "bucket", ["id_key", "doc_id", "digest"], F.lit(1).cast("long"), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
