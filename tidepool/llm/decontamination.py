"""Benchmark decontamination by winnowing.

Words are runs of digits, letters and all characters beyond ASCII, in lower case
(A-Z only).  A benchmark item is cut into windows of ``window`` consecutive words; an
item of fewer words, but not none, is one window.  Every word of a document inside
an occurrence of a window is hit.

Winnowing (Schleimer et al. 2003): the words of a window hold ``window - gram + 1``
word k-grams, and the least of their hashes is the window's fingerprint.  It depends
on the window's words alone, so a span of ``window`` words or more that a document
shares with an item has a fingerprint in common with it, whatever stands around the
span: nothing is lost.  Steps:

1. The fingerprints of all benchmark windows, as a distributed table.
2. One pass over the documents' whole texts.  A bitmap of fixed size (``FILTER_BITS``,
   2 MB whatever the benchmark's size) tells which fingerprints may be the
   benchmark's; it only saves shuffling and loses none.  A window whose fingerprint
   may be is extended to its ten words.
3. Training and test fingerprints are joined, and the words compared in the same
   join.  Overlapping windows unite to maximal hit spans.

Work is done once per distinct text, so a group of copies costs one row per task.  A
window that many items share, and an item that many documents hold, meet by a key of
the *set* of items, never as all pairs.  Such keys are sums of two 64-bit hashes.

Defined results: a null or empty text, or one without words, has no words and no
hits; very long texts are read in pieces that overlap by a window, so no span is lost
at an edge; ties cannot matter, as a window has one least hash; repeated rows, and
rows without doc_id, get one result each; benchmark rows without item_id mark words as
hit, but are named nowhere; repeated benchmark rows count once; an empty benchmark
leaves all documents clean; an empty document table gives an empty result; further
columns are ignored, or returned untouched by ``keep_rows``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import staged

WINDOW, GRAM = 10, 5
FILTER_BITS = 1 << 24
PIECE = 1 << 20              # bytes of text that one step looks at
_SLOT = 64 - (FILTER_BITS.bit_length() - 1)

_LOWER = np.zeros(256, np.uint8)                         # 0: no part of a word
for _first, _last in ((ord("0"), ord("9")), (ord("a"), ord("z")), (0x80, 0xFF)):
    _LOWER[_first:_last + 1] = np.arange(_first, _last + 1)
_LOWER[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP, _SALT = np.uint64(0xC2B2AE3D27D4EB4F), 0xD6E8FEB86659FD93


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the word hash's base and of its inverse, as far as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, size, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, size, 1 << 64))])
        return self.up[:n], self.down[:n]


class _Words(NamedTuple):
    """Words of some texts that stand behind each other: the text each belongs to, its hash,
    and its place in ``plain``, the words joined by one space."""

    text: np.ndarray
    hashes: np.ndarray
    plain: bytes
    first: np.ndarray
    end: np.ndarray

    def phrase(self, at: int, length: int) -> str:
        return self.plain[self.first[at]:self.end[at + length - 1]].decode()


def _words(raw: bytes, begins: np.ndarray, powers: _Powers) -> _Words:
    """``begins``: where each text starts in ``raw``; a separator stands before it."""
    low = _LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends = _edges(raw)
    up, down = powers.upto(len(low) + 1)
    prefix = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(low * up[:-1], out=prefix[1:])
    hashes = _mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)
    lengths = ends - starts
    first = np.cumsum(lengths + 1) - lengths - 1
    keep = low != 0
    keep[starts[1:] - 1] = True                          # one separator between two words
    plain = np.where(low == 0, np.uint8(32), low)[keep]
    return _Words(np.searchsorted(begins, starts, "right") - 1, hashes, plain.tobytes(), first, first + lengths)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def fingerprints(words: _Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and fingerprint of every run of ``length`` words inside one text."""
    n = len(words.hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    width = min(gram, length)
    grams = np.zeros(len(words.hashes) - width + 1, np.uint64)
    for i in range(width):
        grams = _mix(grams * _STEP + words.hashes[i:i + len(grams)])
    at = np.flatnonzero(words.text[:n] == words.text[length - 1:])
    return at, _mix(_least(grams, length - width + 1)[at] ^ np.uint64(length * _SALT % (1 << 64)))


def _edges(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _LOWER[np.frombuffer(raw, np.uint8)] != 0
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def _pieces(raw: bytes, overlap: int) -> Iterator[tuple[bytes, int]]:
    """A long text in pieces of whole words; each but the first begins with the last
    ``overlap`` words of the one before.  With each, the number of words before it."""
    starts, ends = _edges(raw)
    at = 0
    while at < len(starts):
        to = max(int(np.searchsorted(ends, starts[at] + PIECE, "right")), at + overlap + 1)
        yield raw[starts[at]:ends[min(to, len(ends)) - 1]], at
        at = to - overlap if to < len(ends) else len(starts)


def _shape(rows: list[tuple], names: Sequence[str], types: Sequence[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], list(names))


def _groups(texts: list[bytes | None], overlap: int) -> Iterator[tuple[list[int], list[bytes], int]]:
    """Texts in steps of about ``PIECE`` bytes: row numbers, texts, and words before (of a piece of a long text)."""
    rows, step, size = [], [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        if len(text) > PIECE:
            for piece, before in _pieces(text, overlap):
                yield [row], [piece], before
            continue
        rows.append(row)
        step.append(text)
        size += len(text)
        if size >= PIECE:
            yield rows, step, 0
            rows, step, size = [], [], 0
    if rows:
        yield rows, step, 0


def _scan(texts: list[bytes | None], overlap: int, powers: _Powers) -> Iterator[tuple[np.ndarray, _Words, np.ndarray]]:
    """Per step: row of each text, the words, and for each text its first word's number in them less the words before."""
    for rows, step, before in _groups(texts, overlap):
        begins = np.cumsum([0] + [len(t) + 1 for t in step[:-1]])
        words = _words(b" ".join(step), begins, powers)
        yield np.array(rows), words, np.searchsorted(words.text, np.arange(len(step))) - before


def _item_windows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            items = batch.column(0)
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            counts = np.array([len(_edges(t)[0]) for t in texts], np.int64)
            for rows, words, _ in _scan(texts, window - 1, powers):
                for length in {min(window, int(n)) for n in counts[rows] if n}:
                    wanted = counts[rows] >= window if length == window else counts[rows] == length
                    at, prints = fingerprints(words, length, gram)
                    picked = np.flatnonzero(wanted[words.text[at]])
                    out = [(items[int(rows[words.text[at[i]]])].as_py(), length, p, words.phrase(at[i], length))
                           for i, p in zip(picked, prints[picked].view(np.int64).tolist())]
                    yield _shape(out, ("item", "length", "fp", "phrase"), (pa.string(), pa.int32(), pa.int64(), pa.string()))
    return run


def _document_windows(lengths: list[int], gram: int, overlap: int, seen: np.ndarray):
    """Rows of two kinds: each document with its number of words and the key of its text; and
    the windows of its text whose fingerprint may be the benchmark's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        names = ("doc_id", "text_key", "n_words", "start", "length", "fp", "phrase")
        types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            keys = [hashlib.sha256(t).digest() if t else None for t in texts]
            counts = np.zeros(len(texts), np.int64)
            for rows, words, origin in _scan(texts, overlap, powers):
                in_step = np.bincount(words.text, minlength=len(rows))
                counts[rows] = np.maximum(counts[rows], in_step - np.minimum(origin, 0))
                for length in lengths:
                    at, prints = fingerprints(words, length, gram)
                    slot = prints >> np.uint64(_SLOT)
                    picked = np.flatnonzero((seen[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
                    if len(picked):
                        of = words.text[at[picked]]
                        yield _shape([(None, keys[r], None, s, length, p, words.phrase(a, length)) for r, s, p, a in zip(
                            rows[of], (at[picked] - origin[of]).tolist(), prints[picked].view(np.int64).tolist(), at[picked])], names, types)
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(counts), *(pa.nulls(n, t) for t in types[3:])], list(names))
    return run


def _bitmap(prints: DataFrame) -> np.ndarray:
    """Which slots the fingerprints ``fp`` fall in: at most FILTER_BITS / 64 numbers."""
    slot = F.shiftrightunsigned("fp", _SLOT)
    words = prints.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _set_key(column: str) -> list[Column]:
    """Of a set, whatever its order: the size and two sums of hashes."""
    return [F.count(column).alias("k0"), *(F.sum(F.xxhash64(F.lit(i), column).cast("decimal(38,0)")).alias(f"k{i}") for i in (1, 2))]


_KEY = ["k0", "k1", "k2"]


def _as_key(name: str) -> Column:
    return F.when(F.col("k0") > 0, F.concat_ws(":", *_KEY)).alias(name)


class Hits(NamedTuple):
    """``documents`` (doc_id, text_key, n_words), ``windows`` (text_key, start, length, items_key) of the
    texts that hold benchmark windows, ``owners`` (items_key, item)."""

    documents: DataFrame
    windows: DataFrame
    owners: DataFrame


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text",
         doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> Hits:
    """Every occurrence of a benchmark window in the documents; any shared run of ``window`` words is found."""
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).filter("text is not null")
    held = staged(items.mapInArrow(_item_windows(window, gram), "item string, length int, fp long, phrase string").distinct(), "held")
    # which items hold a phrase, as one key per set of items
    phrases = staged(held.groupBy("length", "fp", "phrase").agg(*_set_key("item"))
                     .select("length", "fp", "phrase", _as_key("items_key")), "phrases")
    owners = staged(held.filter("item is not null").join(phrases.hint("merge"), ["length", "fp", "phrase"])
                    .select("items_key", "item").distinct(), "owners")
    lengths = sorted(r["length"] for r in held.select("length").distinct().collect())       # at most ``window`` numbers
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = staged(rows.mapInArrow(_document_windows(lengths, gram, window - 1, _bitmap(phrases)),
                                   "doc_id long, text_key binary, n_words long, start long, length int, fp long, phrase string"), "found")
    maybe = found.filter("start is not null").select("text_key", "start", "length", "fp", "phrase").distinct()
    hits = maybe.join(phrases.hint("merge"), ["length", "fp", "phrase"]).select("text_key", "start", "length", "items_key")
    return Hits(found.filter("start is null").select("doc_id", "text_key", "n_words"), staged(hits, "hits"), owners)


def spans(hits: Hits) -> DataFrame:
    """Maximal hit spans, in words from 0, end exclusive: ``text_key, start, end``."""
    end = F.col("start") + F.col("length")
    order = Window.partitionBy("text_key").orderBy("start", "length")
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = (hits.windows.select("text_key", "start", "length", end.alias("end"), F.coalesce(F.col("start") > reach, F.lit(True)).alias("new"))
            .withColumn("run", F.sum(F.col("new").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    return runs.groupBy("text_key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def items(hits: Hits) -> DataFrame:
    """``text_key, n_items, items``: per text the items with occurring windows, in the order of their ids as strings.

    Texts that meet the same set of items are worked out once."""
    sets = staged(hits.windows.filter("items_key is not null").select("text_key", "items_key").distinct(), "sets")
    per_text = staged(sets.groupBy("text_key").agg(*_set_key("items_key")).select("text_key", _as_key("set_key")), "per_text")
    members = sets.join(per_text.hint("merge"), "text_key").select("set_key", "items_key").distinct()
    named = members.join(hits.owners.hint("merge"), "items_key").select("set_key", "item").distinct()
    lists = named.groupBy("set_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return (per_text.join(lists.hint("merge"), "set_key")
            .select("text_key", F.size("items").cast("long").alias("n_items"), "items"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    hits = find(docs, benchmark, **options)
    words = spans(hits).groupBy("text_key").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    named = items(hits).select("text_key", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    texts = staged(words.join(named, "text_key", "left"), "texts").withColumnRenamed("text_key", "hit_key")
    joined = hits.documents.join(texts.hint("merge"), F.col("text_key") == F.col("hit_key"), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                         F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def keep_rows(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents, all columns, that hold no benchmark window."""
    keys = find(docs, benchmark, text=text, **options).windows.select("text_key").distinct()
    row = docs.select(F.unhex(F.sha2(F.col(text), 256)).alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return row.join(keys.hint("merge"), F.col("row_key") == F.col("text_key"), "left_anti").select("row.*")
