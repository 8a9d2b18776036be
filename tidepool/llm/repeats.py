"""Removal of repeated passages: every byte that a window of ``width`` bytes covers
which also starts earlier (in a document with a smaller doc_id, or earlier in the
same document) goes.  The comparison is by suffix arrays built by induced sorting
(``suffixes``), one per shard, over just the text that can repeat.

1. Anchors.  Among the ``GRAM``-byte strings of a window, the one with the least
   hash (leftmost on ties) is the window's anchor.  Equal windows have equal
   anchors, at the same place.  A run of windows with one anchor is a segment.
   Segments with equal content that meet in a batch are merged to the earliest at
   once, the others are repeats; so frequent passages do not flood a shard.
2. Anchors are dealt to shards by hash, packed; those that occur once are dropped.
   A shard holds the anchors of a bounded number of bytes.
3. The text of the remaining segments is cut from the documents, and dealt by
   anchor.  Anchors with very many different segments are dealt by single windows
   instead, which spreads them (equal windows still meet).
4. In a shard, equal segments are merged to the earliest.  Anchors that keep more
   than one segment get a suffix array: suffixes that share ``width`` bytes with
   the one before form a class, of which the earliest window stays.
5. The runs of repeated windows are collected by document and cut out.

Windows are judged on the input, not on what is left.  Matches never cross
documents.

Defined results: doc_id names a document and gives the order, so rows that repeat
it repeat the text and share one result; rows without doc_id have no place in the
order and are left as they are; a null text counts as empty; texts shorter than a
window are left as they are; an empty table gives an empty result; further columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import staged, text_or_empty
from tidepool.llm.suffixes import common_prefixes, suffix_array

WIDTH, GRAM = 100, 32
BUFFER = 1 << 20              # bytes hashed at once; positions in it fit the low bits of a key
SHARD_BYTES = 16 << 20        # text whose anchors make up a shard
BLOCK_BYTES = 2 << 20         # text of one suffix array, if no anchor has more
CUT_ROWS = 4_000              # documents whose segments are held at once
DENSE = "zstd"                # of the staged anchors and segments, whose bytes count as disk
HOT_SEGMENTS = 10_000         # different segments of an anchor above which it is dealt by windows
_BASE = 0x9E3779B97F4A7C15
_ANCHOR = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("n", "<u2")])
_SPOT = np.dtype([("anchor", "<u8"), ("start", "<i8"), ("n", "<u2")])
RUN = "doc_id long, start long, n long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Hasher:
    """Polynomial hashes of any stretches of a buffer, from prefix sums."""

    def __init__(self):
        base = np.full(BUFFER + 1, _BASE, np.uint64)
        base[0] = 1
        self.power = np.cumprod(base)
        base[1:] = pow(_BASE, -1, 1 << 64)
        self.inverse = np.cumprod(base)

    def load(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _buffers(docs: list[tuple[int, bytes]], width: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Pieces (doc, offset, bytes) in lots of at most BUFFER bytes; pieces of a text overlap by a window less one."""
    lot, size = [], 0
    for doc, text in docs:
        for at in range(0, max(1, len(text) - width + 1), BUFFER - width + 1):
            piece = text[at:at + BUFFER]
            if size + len(piece) > BUFFER:
                yield lot
                lot, size = [], 0
            lot.append((doc, at, piece))
            size += len(piece)
    if lot:
        yield lot


def segments_of(docs: list[tuple[int, bytes]], hasher: Hasher, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The segments of texts as ``_ANCHOR`` rows, with a key of anchor and content."""
    rows, keys = [], []
    for lot in _buffers(docs, width):
        data = np.frombuffer(b"".join(p for _, _, p in lot), np.uint8)
        if len(data) < width:
            continue
        sizes = np.array([len(p) for _, _, p in lot])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        hasher.load(data)
        place = np.arange(len(data) - gram + 1)
        grams = hasher.of(slice(0, len(place)), slice(gram, None))
        low = (grams & ~np.uint64(BUFFER - 1)) | place.astype(np.uint64)
        span, step = width - gram + 1, 1
        while step * 2 <= span:                      # minimum over a sliding span, by doubling
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < span:
            low = np.minimum(low[:len(low) - (span - step)], low[span - step:])
        at = (low & np.uint64(BUFFER - 1)).astype(np.int64)
        piece = np.repeat(np.arange(len(lot)), sizes)[:len(at)]
        ok = (np.arange(len(at)) + width) <= (begin + sizes)[piece]
        first = ok.copy()
        first[1:] &= ~ok[:-1] | (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])
        last = ok.copy()
        last[:-1] &= ~ok[1:] | first[1:]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        row = np.empty(len(s), _ANCHOR)
        row["anchor"] = grams[at[s]]
        row["doc"] = np.array([d for d, _, _ in lot], np.int64)[piece[s]]
        row["start"] = np.array([o for _, o, _ in lot], np.int64)[piece[s]] + s - begin[piece[s]]
        row["n"] = e - s + 1
        rows.append(row)
        keys.append(_mix(row["anchor"] * np.uint64(3) + hasher.of(s, e + width) + row["n"]))
    if not rows:
        return np.empty(0, _ANCHOR), np.empty(0, np.uint64)
    return np.concatenate(rows), np.concatenate(keys)


def _merge(keys: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By key: the rows that stay (one, the earliest), and the rows that repeat an earlier one."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort((start, doc, keys))
    head = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    lead = order[head][np.cumsum(head) - 1]          # the earliest of each row's key
    repeat = (doc[order] != doc[lead]) | (start[order] != start[lead])
    return order[head], order[repeat]


def _pack(rows: np.ndarray) -> bytes:
    """Anchor rows, by document and start, as planes of bytes with documents as steps: the bytes that hardly
    change lie together, so that compression leaves little more than anchor, low bytes of start and length."""
    rows = rows[np.lexsort((rows["start"], rows["doc"]))]
    rows["doc"][1:] = np.diff(rows["doc"])
    return rows.view(np.uint8).reshape(len(rows), _ANCHOR.itemsize).T.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(_ANCHOR.itemsize, len(blob) // _ANCHOR.itemsize)
    rows = planes.T.copy().view(_ANCHOR).reshape(-1)
    rows["doc"] = np.cumsum(rows["doc"])
    return rows


def _utf8(batch: pa.RecordBatch) -> list[tuple[int, bytes]]:
    return [(d, t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())]


def _anchors(shards: int, width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            rows, keys = segments_of(_utf8(batch), hasher, width, gram)
            if not len(rows):
                continue
            keep, repeat = _merge(keys, rows["doc"], rows["start"])
            gone, rows = rows[repeat], rows[keep]
            shard = (rows["anchor"] >> np.uint64(16)) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            ids, at = np.unique(shard[order], return_index=True)
            blobs = [_pack(part) for part in np.split(rows[order], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "blob"])
            # repeats travel as a row of their own kind
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([_pack(gone)], pa.binary())], ["shard", "blob"])
    return run


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            yield _run_batch(_unpack(blob))


def _run_batch(rows: np.ndarray) -> pa.RecordBatch:
    """Runs of window starts, neighbours joined."""
    rows = rows[np.lexsort((rows["start"], rows["doc"]))]
    doc, start, end = rows["doc"], rows["start"], rows["start"] + rows["n"]
    new = np.ones(len(rows), bool)
    if len(rows) > 1:
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(new)
    stop = np.maximum.reduceat(end, at) if len(at) else end
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(start[at]), pa.array(stop - start[at])], ["doc_id", "start", "n"])


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By shard (rows come sorted by it): the segments whose anchor occurs again, by document."""

    def repeated(blobs: list[bytes]) -> pa.RecordBatch:
        rows = np.concatenate([_unpack(b) for b in blobs])
        rows = rows[np.argsort(rows["anchor"], kind="stable")]
        same = rows["anchor"][1:] == rows["anchor"][:-1]
        rows = rows[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        rows = rows[np.argsort(rows["doc"], kind="stable")]
        docs, at = np.unique(rows["doc"], return_index=True)
        spots = np.empty(len(rows), _SPOT)
        for name in _SPOT.names:
            spots[name] = rows[name]
        parts = [p.tobytes() for p in np.split(spots, at[1:])] if len(docs) else []
        return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(parts, pa.binary())], ["doc_id", "spots"])

    shard, blobs = None, []
    for batch in batches:
        for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if s != shard and blobs:
                yield repeated(blobs)
                blobs = []
            shard = s
            blobs.append(blob)
    if blobs:
        yield repeated(blobs)


def _cut(width: int):
    """The text of the spotted segments; equal ones in a batch merged to the earliest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, CUT_ROWS) for b in batches for at in range(0, b.num_rows, CUT_ROWS)):
            first: dict[tuple[int, bytes], tuple[int, int]] = {}
            gone = []
            for doc, text, lots in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(),
                                       batch.column(2).to_pylist()):
                for lot in lots:
                    for anchor, start, n in np.frombuffer(lot, _SPOT).tolist():
                        key, here = (anchor, text[start:start + n + width - 1]), (doc, start)
                        there = first.setdefault(key, here)
                        if there != here:
                            first[key] = min(there, here)
                            gone.append((*max(there, here), n))
            keys, heads = list(first), list(first.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array([a for a, _ in keys], np.uint64).view(np.int64)), pa.array([s for _, s in keys], pa.binary()),
                 pa.array([d for d, _ in heads], pa.int64()),
                 pa.array([s for _, s in heads], pa.int64()), pa.array([len(s) - width + 1 for _, s in keys], pa.int64())],
                ["anchor", "segment", "doc_id", "start", "n"])
            if gone:
                d, s, n = zip(*gone)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(gone), pa.int64()), pa.nulls(len(gone), pa.binary()), pa.array(d, pa.int64()),
                     pa.array(s, pa.int64()), pa.array(n, pa.int64())], ["anchor", "segment", "doc_id", "start", "n"])
    return run


def _windows(width: int):
    """Single windows of segments, as segments dealt by their own content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text, doc, start = (batch.column(c)[row].as_py() for c in (1, 2, 3))
                cuts = [text[i:i + width] for i in range(len(text) - width + 1)]
                keys = [int.from_bytes(hashlib.blake2b(c, digest_size=8).digest(), "little", signed=True) for c in cuts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(cuts, pa.binary()), pa.array([doc] * len(cuts), pa.int64()),
                     pa.array(range(start, start + len(cuts)), pa.int64()), pa.array([1] * len(cuts), pa.int64())],
                    ["anchor", "segment", "doc_id", "start", "n"])
    return run


def repeated_starts(segments: list[bytes], doc: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """``_ANCHOR`` rows (runs of single windows) that repeat an earlier window, by a suffix
    array over different segments; ``doc`` and ``start`` place each segment."""
    text = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)    # 0xFF is in no UTF-8 text
    sizes = np.array([len(s) for s in segments])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    sa = suffix_array(text, width)
    of = np.repeat(np.arange(len(segments)), sizes + 1)
    is_window = (np.arange(len(text)) + width) <= (begin + sizes)[of]
    shared = common_prefixes(text, sa, width)
    joined = shared[sa] >= width                     # suffix equals the one before it, as far as windows go
    group = np.cumsum(~joined)
    at, group = sa[is_window[sa]], group[is_window[sa]]
    counts = np.bincount(group)
    several = counts[group] > 1
    at, group = at[several], group[several]
    where = of[at]
    d, s = doc[where], start[where] + at - begin[where]
    _, repeat = _merge(group, d, s)
    out = np.zeros(len(repeat), _ANCHOR)
    out["doc"], out["start"], out["n"] = d[repeat], s[repeat], 1
    return out


def _classes(width: int):
    def block(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        """All segments of some anchors."""
        anchor = batch.column("anchor").to_numpy()
        doc, start, n = (batch.column(c).to_numpy() for c in ("doc_id", "start", "n"))
        text = batch.column("segment").to_pylist()
        number: dict[bytes, int] = {}
        content = np.array([number.setdefault(t, len(number)) for t in text], np.int64)
        keep, repeat = _merge(content, doc, start)   # equal segments have equal anchors
        gone = np.zeros(len(repeat), _ANCHOR)
        gone["doc"], gone["start"], gone["n"] = doc[repeat], start[repeat], n[repeat]
        found = [gone]
        keep = keep[np.argsort(anchor[keep], kind="stable")]
        same = anchor[keep][1:] == anchor[keep][:-1]
        keep = keep[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        if len(keep):
            found.append(repeated_starts([text[i] for i in keep], doc[keep], start[keep], width))
        rows = np.concatenate(found)
        if len(rows):
            yield _run_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; a block is closed between two anchors."""
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                anchor = batch.column(0).to_numpy()
                if size >= BLOCK_BYTES:
                    other = np.flatnonzero(anchor != held[-1].column(0)[-1].as_py())
                    cut = int(other[0]) if len(other) else batch.num_rows
                    held.append(batch.slice(0, cut))
                    if cut < batch.num_rows:
                        yield from block(pa.Table.from_batches([b for b in held if b.num_rows]))
                        held, size = [], 0
                    batch = batch.slice(cut)
                    if not held:
                        continue
                else:
                    part = batch.slice(0, 4096)
                    held.append(part)
                    size += part.column(1).nbytes
                    batch = batch.slice(4096)
        if held:
            yield from block(pa.Table.from_batches([b for b in held if b.num_rows]))
    return run


def _remove(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(),
                                       batch.column(2).to_pylist()):
                spans: list[list[int]] = []
                for start, end in sorted((r["start"], r["start"] + r["n"] + width - 1) for r in runs or ()):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(end, spans[-1][1])
                    else:
                        spans.append([start, end])
                edges = [0, *(x for span in spans for x in span), len(text)]
                left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((doc, len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(),
                            left if with_text else None))
            columns = list(zip(*out)) if out else [()] * 6
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays(arrays[:6 if with_text else 5], names[:6 if with_text else 5])
    return run


def repeated_runs(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, start, n``: runs of ``n`` window starts (bytes) that repeat earlier windows; runs may overlap.

    ``docs`` has ``doc_id, text``, neither null."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / SHARD_BYTES))
    marks = staged(docs.mapInArrow(_anchors(8 * parts, width, gram), "shard int, blob binary"), "anchors", DENSE)
    early = marks.filter("shard < 0").select("blob").mapInArrow(_runs_of, RUN)
    spots = (marks.filter("shard >= 0").repartition(parts, "shard").sortWithinPartitions("shard")
             .mapInArrow(_spots, "doc_id long, spots binary"))
    spots = staged(spots.groupBy("doc_id").agg(F.collect_list("spots").alias("spots")), "spots")
    segments = staged(docs.join(spots, "doc_id").select("doc_id", "text", "spots").mapInArrow(
        _cut(width), "anchor long, segment binary, doc_id long, start long, n long"), "segments", DENSE)
    live = segments.filter("segment is not null")
    hot = staged(live.groupBy("anchor").count().filter(F.col("count") > HOT_SEGMENTS).select("anchor"), "hot")
    dealt = (live.join(hot, "anchor", "left_anti")
             .unionByName(live.join(hot, "anchor", "left_semi").select("anchor", "segment", "doc_id", "start", "n")
                          .mapInArrow(_windows(width), live.schema)))
    classes = (dealt.select("anchor", "segment", "doc_id", "start", "n")
               .repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_classes(width), RUN))
    return early.unionByName(segments.filter("segment is null").select("doc_id", "start", "n")).unionByName(classes)


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, text: str = "text",
                    with_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept``, the bytes left."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    known = docs.filter(F.col("doc_id").isNotNull())
    runs = staged(repeated_runs(known.filter(F.octet_length("text") >= width), width, gram), "runs")
    by_doc = staged(runs.groupBy(F.col("doc_id").alias("r_id")).agg(F.collect_list(F.struct("start", "n")).alias("runs")), "by_doc")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return (docs.join(by_doc, F.col("doc_id") == F.col("r_id"), "left").select("doc_id", "text", "runs")
            .mapInArrow(_remove(width, with_text), schema))
