"""Near-duplicate detection with SuperMinHash signatures.

A document's set holds its distinct word shingles, as 64-bit hashes.  In
SuperMinHash (Ertl 2017) every shingle draws a random permutation of the
signature's positions; at its j-th place it offers the value ``j + r`` with a
random ``r`` in [0, 1), and a position keeps the least offer.  The values of one
shingle are correlated (one per position and place), which lowers the variance of
the estimate; and once every position holds a value below ``j + 1``, the later
places of all shingles cannot matter, so generation stops early.

Steps:

1. One pass over the texts: set size, a digest of the set, the signature.
2. Rows with equal sets form a class, represented by the smallest doc_id
   (a grouped minimum, merged map-side: a group of copies costs one row per task).
3. Banding: representatives that agree in a whole band share a bucket.  Every
   member of a bucket is linked to its smallest member if the full sets confirm
   it, and the links are merged by union-find (``connected``).
4. Buckets whose members then still lie in several components are compared member
   by member, in blocks of at most about ``BLOCK`` rows against each other, inside
   the tasks: pairs of different components are judged by their full sets, each in
   its first common band only.  What leaves a task are the links that connect
   components, less than one per member.  They are merged like the others.

So every pair of classes that shares a band is either confirmed, refuted or known
to be connected; no pair is dropped, and a group of near copies costs one link
per member, not all pairs.  With 32 bands of 4, a pair at the threshold of 0.8
shares no band with probability 5e-8.

Defined results: doc_id names a document, so rows that repeat it repeat the text and
share one result; null texts and texts without words have empty sets and are linked
with nothing; a text of fewer words than a shingle has its whole word sequence as its
one shingle; rows without doc_id go with the numbered rows of an equal set, else their
component is null and they are kept; an empty table gives an empty result; further
columns of the input are ignored, or returned untouched by ``keep_rows``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import staged
from tidepool.llm.connected import components

BANDS, ROWS = 32, 4
BLOCK = 256
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                             0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word, remembered for frequent words."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < 500_000:
            self[word] = value
        return value


def shingle_set(text: str | None, hashes: WordHashes, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; bytes.lower() and bytes.split() know ASCII only, as wanted."""
    tokens = text.encode().lower().split() if text else []
    h = np.fromiter((hashes[t] for t in tokens), np.uint64, len(tokens))
    if not len(h):
        return h
    width = min(words, len(h))
    n = len(h) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total = _mix(total * _C[i % len(_C)] + h[i:i + n])
    return np.unique(total)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """SuperMinHash signatures (documents x size, float64; inf for empty sets)."""
    out = np.full((len(sets), size), np.inf)
    docs = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    perm: np.ndarray | None = None   # the permutations so far, only once a second place is needed
    for place in range(size):
        if not len(items):
            break
        draw = _mix(items + np.uint64((place + 1) * int(_C[0]) % 2 ** 64))
        value = place + (draw >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
        pick = place + (_mix(draw) % np.uint64(size - place)).astype(np.int64)
        row = np.arange(len(items))
        if place == 0:
            at, first = pick, pick
        else:
            if perm is None:
                perm = np.tile(np.arange(size, dtype=np.int16), (len(items), 1))
                perm[row, first], perm[:, 0] = 0, first
            at = perm[row, pick].astype(np.int64)
            perm[row, pick] = perm[:, place]
            perm[:, place] = at
        np.minimum.at(out.reshape(-1), docs * size + at, value)
        # early stop, per document: every position holds a value that no later place can beat
        going = (out.max(axis=1) >= place + 1)[docs]
        if not going.all():
            docs, items = docs[going], items[going]
            first = first[going]
            perm = None if perm is None else perm[going]
    return out


def _profile(words: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_set(t, hashes, words) for t in part.column(1).to_pylist()]
                # what a band compares: 32 bits of each value
                sig = _mix(signatures(sets, size).view(np.uint64)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([g.tobytes() if len(s) else None for s, g in zip(sets, sig)], pa.binary()),
                ], ["doc_id", "n_shingles", "set_key", "signature"])
    return run


def _sets_of(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            blobs = [shingle_set(t, hashes, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["s_rep", "items"])
    return run


def _compare_blocks(threshold: float):
    """Links between different components inside a block of a bucket, or between two
    blocks, by their full sets.  What a link connects counts as one component from then on."""
    percent = round(threshold * 100)

    def links(a: dict, b: dict, band: int) -> Iterator[tuple[int, int]]:
        for i in range(len(a["rep"])):
            start = i + 1 if a is b else 0
            n = a["n"][i]
            small, large = np.minimum(b["n"][start:], n), np.maximum(b["n"][start:], n)
            other = np.flatnonzero((b["comp"][start:] != a["comp"][i]) & (100 * small >= percent * large)) + start
            # the pair is judged in the first band that it shares
            other = other[(b["bands"][other] == a["bands"][i]).argmax(axis=1) == band]
            if not len(other):
                continue
            mine = a["items"][i]
            theirs = [b["items"][j] for j in other]
            items = np.concatenate(theirs)
            place = np.minimum(np.searchsorted(mine, items), len(mine) - 1)
            sizes = b["n"][other]
            both = np.add.reduceat((mine[place] == items).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            for j in other[100 * both >= percent * (n + sizes - both)]:
                old, new = b["comp"][j], a["comp"][i]
                if old != new:
                    for side in (a, b):
                        side["comp"][side["comp"] == old] = new
                    yield min(a["rep"][i], b["rep"][j]), max(a["rep"][i], b["rep"][j])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        band, left, right = (key[0].as_py(), key[2].as_py(), key[3].as_py())
        sides = {}
        for block in {left, right}:
            t = table.filter(pc.equal(table.column("block"), block))
            items = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
            sides[block] = {"rep": t.column("rep").to_numpy(), "comp": t.column("comp").to_numpy().copy(), "items": items,
                            "n": np.array([len(x) for x in items], np.int64),
                            "bands": np.array(t.column("bands").to_pylist(), np.int64).reshape(len(items), -1)}
        found = list(links(sides[left], sides[right], band))
        return pa.table({"a": pa.array([int(a) for a, _ in found], pa.int64()),
                         "b": pa.array([int(b) for _, b in found], pa.int64())})

    return run


def _confirm(words: int, threshold: float):
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, set_a = WordHashes(), None, None
        for batch in batches:
            keep = []
            ids, texts_a, texts_b = batch.column(0), batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                if (a := ids[i].as_py()) != last:
                    last, set_a = a, shingle_set(texts_a[i].as_py(), hashes, words)
                set_b = shingle_set(texts_b[i].as_py(), hashes, words)
                both = len(np.intersect1d(set_a, set_b, assume_unique=True))
                keep.append(100 * both >= percent * (len(set_a) + len(set_b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the threshold; ``texts`` is ``id, text``.

    The side of the many small partners is joined first, the hubs last, by joins
    whose hot keys Spark splits."""
    pairs = staged(pairs.distinct(), "pairs")
    wide = staged(pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"), "wide")
    wide = wide.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return staged(wide.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(words, threshold), "a long, b long"), "linked")


def near_groups(docs: DataFrame, words: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS,
                text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    base = staged(docs.mapInArrow(_profile(words, bands * rows),
                                  "doc_id long, n_shingles long, set_key binary, signature binary"), "profiles")
    classes = staged(base.filter("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("signature").alias("signature")), "classes")

    width = rows * 4
    band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))
    in_bands = (classes.filter("rep is not null").select("rep", "n", "signature", band.alias("band"))
                .select("band", F.xxhash64(F.expr(f"substring(signature, band * {width} + 1, {width})")).alias("bucket"), "rep"))
    buckets = in_bands.groupBy("band", "bucket").agg(F.min("rep").alias("head"), F.count("*").alias("members")).filter("members > 1")
    member = staged(in_bands.join(staged(buckets, "buckets"), ["band", "bucket"]), "members")
    # The texts are shuffled once, for what shares a bucket with another class.
    needed = staged(member.select(F.col("rep").alias("id")).distinct(), "needed")
    texts = staged(docs.select(F.col("doc_id").alias("id"), "text").join(needed.hint("merge"), "id", "left_semi"), "texts")
    stars = member.filter("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b"))
    links = confirmed(stars, texts, words, threshold)
    tree = components(links)

    rest = member.join(tree.withColumnRenamed("node", "t_node"), F.col("rep") == F.col("t_node"), "left").select(
        "band", "bucket", "rep", F.coalesce("root", "rep").alias("comp"))
    rest = staged(rest, "rest")
    open_ = (rest.groupBy("band", "bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("members"))
             .filter("c0 <> c1").select("band", "bucket", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")))
    open_ = staged(open_, "open")
    if not open_.isEmpty():
        rest = staged(rest.join(open_, ["band", "bucket"]), "open_rows")
        judged = staged(rest.select(F.col("rep").alias("id")).distinct(), "judged")
        sets = staged(texts.join(judged, "id", "left_semi").select("id", "text").mapInArrow(_sets_of(words), "s_rep long, items binary"), "sets")
        all_bands = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(F.substring("signature", k * width + 1, F.lit(width))))
        keys = staged(classes.join(judged, F.col("rep") == F.col("id"), "left_semi").select(F.col("rep").alias("k_rep"), all_bands.alias("bands")), "keys")
        rows_ = (rest.join(keys, F.col("rep") == F.col("k_rep")).join(sets, F.col("rep") == F.col("s_rep"))
                 .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")))
        more = staged(rows_.select("band", "bucket", "left", "right", "block", "rep", "comp", "bands", "items")
                      .groupBy("band", "bucket", "left", "right").applyInArrow(_compare_blocks(threshold), "a long, b long"), "more")
        if not more.isEmpty():
            tree = components(links.unionByName(more))

    named = (classes.select("set_key", "rep").join(tree.withColumnRenamed("node", "t_node"), F.col("rep") == F.col("t_node"), "left")
             .select(F.col("set_key").alias("c_key"), F.coalesce("root", "rep").alias("component"),
                     (F.col("rep") == F.coalesce("root", "rep")).alias("is_root")))
    return (base.join(staged(named, "named"), F.col("set_key") == F.col("c_key"), "left")
            .withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component")))
            .select("doc_id", "n_shingles", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def keep_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, of which one per component stays."""
    gone = staged(near_groups(docs, **options).filter("not kept").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    row = docs.select(F.col("doc_id").cast("long").alias("row_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return row.join(gone.hint("merge"), F.col("row_id") == F.col("gone_id"), "left_anti").select("row.*")
