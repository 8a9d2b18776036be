"""Exact deduplication through a sharded cuckoo-filter index.

The index is a table of live digests, ``digest, keep_id, n``: the SHA-256 of a
text, the largest doc_id that carries it and the number of rows.  Digests are
dealt to shards by their first bytes.  In a shard, a cuckoo filter of 16-bit
fingerprints takes the changes in order:

* a digest that the filter does not contain is new: it is inserted and its row
  needs no further look;
* a hit may be a false positive; hits, and only they, are verified against the
  bucketed content, i.e. grouped with the live rows by the full digest;
* a digest that is deleted gives its fingerprint's slot back (deletes are first
  checked against the live content, since a cuckoo filter may only forget what it
  holds);
* if an insertion finds no slot, the filter doubles and is refilled from the
  shard's stored keys.

A hot text cannot flood a shard: every map task merges its own copies before the
shuffle, so a shard gets one row per task and text at most.

Defined results: a null text counts as empty, so null and empty texts are equal;
a null doc_id is smaller than any other; if several rows share text and doc_id,
exactly one of them is kept; an empty table gives an empty result; further
columns of the input are ignored, or returned untouched by ``keep_rows``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import staged, text_or_empty

SLOTS = 4
MAX_KICKS = 200
KEYS_PER_SHARD = 1_000_000
_MIX = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1
STORED, DELETE, INSERT = 0, 1, 2


class CuckooFilter:
    """Partial-key cuckoo filter over 64-bit keys, which it keeps for resizing."""

    def __init__(self, buckets: int = 256):
        self.keys: dict[int, int] = {}
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table = [0] * (buckets * SLOTS)

    def _places(self, key: int) -> tuple[int, int, int]:
        mixed = (key * _MIX) & _M64
        print_ = (mixed >> 48) or 1
        first = (mixed >> 8) & self.mask
        return print_, first, (first ^ (print_ * 0x5BD1E995)) & self.mask

    def contains(self, key: int) -> bool:
        print_, a, b = self._places(key)
        t = self.table
        return print_ in t[a * SLOTS:a * SLOTS + SLOTS] or print_ in t[b * SLOTS:b * SLOTS + SLOTS]

    def insert(self, key: int) -> None:
        """Adds the key, which has one slot however often it is added; doubles the table if it finds none."""
        self.keys[key] = self.keys.get(key, 0) + 1
        if self.keys[key] == 1 and not self._place(key):
            self._grow()

    def delete(self, key: int) -> bool:
        """Takes back one insertion of a key, with the last one its slot; False if it is not there."""
        left = self.keys.get(key, 0)
        if left > 1:
            self.keys[key] = left - 1
        if left != 1:
            return left > 1
        del self.keys[key]
        print_, a, b = self._places(key)
        for bucket in (a, b):
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.table[i] == print_:
                    self.table[i] = 0
                    return True
        raise AssertionError("a stored key has no fingerprint")

    def _put(self, bucket: int, print_: int) -> bool:
        for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.table[i]:
                self.table[i] = print_
                return True
        return False

    def _place(self, key: int) -> bool:
        print_, a, b = self._places(key)
        if self._put(a, print_) or self._put(b, print_):
            return True
        at = b
        for kick in range(MAX_KICKS):
            i = at * SLOTS + (kick + print_) % SLOTS
            print_, self.table[i] = self.table[i], print_
            at = (at ^ (print_ * 0x5BD1E995)) & self.mask
            if self._put(at, print_):
                return True
        return False

    def _grow(self) -> None:
        buckets = (self.mask + 1) * 2
        while True:
            self._clear(buckets)
            if all(self._place(k) for k in self.keys):
                return
            buckets *= 2


def _merge_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with one digest and kind as one row: largest id, sum of counts."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by(["kind", "digest"]).aggregate([("doc_id", "max"), ("n", "sum")])
        yield from t.rename_columns(["kind", "digest", "doc_id", "n"]).to_batches()


def _through_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs the rows of shards, each in the order stored, delete, insert, through filters."""
    shard, live = None, CuckooFilter()
    for batch in batches:
        hits = []
        for s, kind, digest in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "digest"))):
            if s != shard:
                shard, live = s, CuckooFilter()
            key = int.from_bytes(digest[8:16], "big")
            if kind == DELETE:
                live.delete(key)
                hits.append(True)
            elif live.contains(key):
                hits.append(True)
            else:
                live.insert(key)
                hits.append(False)
        yield batch.append_column("hit", pa.array(hits, pa.bool_()))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text_or_empty(text), 256))


def update_index(index: DataFrame | None, inserts: DataFrame, deletes: DataFrame | None = None,
                 keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """The index after some digests were deleted and ``inserts`` (``doc_id, digest``) added.

    ``index`` has the columns ``digest, keep_id, n`` (None: empty); ``deletes`` a
    column ``digest``: such texts are no longer live, a later insert is new again.
    """
    rows = inserts.select(F.lit(INSERT).alias("kind"), "digest", "doc_id", F.lit(1).cast("long").alias("n"))
    keys = inserts.count()
    if index is not None:
        index = index.select("digest", "keep_id", "n")
        keys += index.count()
        stored = index.select(F.lit(STORED).alias("kind"), "digest", F.col("keep_id").alias("doc_id"), "n")
        rows = rows.unionByName(stored)
        if deletes is not None:
            gone = deletes.select("digest").distinct().join(index, "digest")  # only what is live
            rows = rows.unionByName(gone.select(F.lit(DELETE).alias("kind"), "digest",
                                                F.col("keep_id").alias("doc_id"), "n"))
    shards = max(1, math.ceil(keys / keys_per_shard))
    spread = max(shards, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    merged = rows.mapInArrow(_merge_copies, rows.schema)
    dealt = (merged.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(spread)).cast("int"))
             .repartition(spread, "shard").sortWithinPartitions("shard", "kind", "digest"))
    seen = staged(dealt.mapInArrow(
        _through_filter, "kind int, digest binary, doc_id long, n long, shard int, hit boolean"), "cuckoo")
    # Rows that were never hit are live and alone; what was hit is verified by the whole digest.
    doubtful = seen.filter("hit").select("digest").distinct()
    sure = seen.join(doubtful, "digest", "left_anti").select("digest", F.col("doc_id").alias("keep_id"), "n")
    deleted = F.max(F.when(F.col("kind") == DELETE, F.lit(1)).otherwise(0))
    counted = (F.col("kind") == INSERT) | ((F.col("kind") == STORED) & (F.col("deleted") == 0))
    verified = (seen.join(doubtful, "digest", "left_semi")
                .groupBy("digest", "kind").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n"))
                .groupBy("digest").agg(
                    deleted.alias("deleted"),
                    F.collect_list(F.struct("kind", "doc_id", "n")).alias("rows"))  # three kinds at most
                .select("digest", "deleted", F.inline("rows")).filter(counted)
                .groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("n")))
    return sure.unionByName(verified)


def exact_groups(docs: DataFrame, text: str = "text", keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col(text)).alias("digest")), "digests")
    index = update_index(None, rows, keys_per_shard=keys_per_shard)
    groups = staged(index.filter("n > 1").select(F.col("digest").alias("g_digest"), "keep_id", "n"), "groups")
    # Rows that repeat a (text, doc_id) are numbered, so that one of them can be kept.
    nth = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy(F.lit(1)))
    in_group = F.col("g_digest").isNotNull()
    return (rows.withColumn("nth", nth).join(groups, F.col("digest") == F.col("g_digest"), "left")
            .select("doc_id",
                    F.when(in_group, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
                    F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
                    (~in_group | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1))).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def keep_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents, all columns, of which one row per distinct text stays."""
    gone = (exact_groups(docs, text).filter("not kept")
            .select(F.col("doc_id").alias("gone_id"), F.unhex("text_sha256").alias("gone_digest"), "keep_id"))
    gone = staged(gone, "gone")
    row = docs.select(F.col("doc_id").cast("long").alias("row_id"), digest_of(F.col(text)).alias("row_digest"),
                      F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("row_id").eqNullSafe(F.col("gone_id")) & (F.col("row_digest") == F.col("gone_digest"))
    single = row.join(gone.select("gone_id", "gone_digest").hint("merge"), same, "left_anti")
    # Rows that repeat both text and doc_id of the row that stays: one of them comes back.
    again = gone.filter(F.col("gone_id").eqNullSafe(F.col("keep_id"))).select("gone_id", "gone_digest").distinct()
    repeated = (row.join(again, same, "left_semi")
                .withColumn("nth", F.row_number().over(Window.partitionBy("row_id", "row_digest").orderBy(F.lit(1))))
                .filter("nth = 1").drop("nth"))
    return single.unionByName(repeated).select("row.*")
