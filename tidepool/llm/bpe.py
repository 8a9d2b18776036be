"""Byte-level BPE encoding and decoding with the tiktoken library.

The rank file is a parameter (a local file on every worker, never copied).  Long
texts are encoded piece by piece; a text is only cut at positions where no match
of the pre-splitting pattern can span the cut (see ``safe_pieces``), so the ids
are those of one call over the whole text.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to no bytes; repeated rows give equal results row by row; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

PIECE_CHARS = 1 << 16

#: A cut is safe before a blank that follows a non-blank (no match runs from a
#: non-blank into a blank), and before the last blank of a run in front of a
#: non-blank (the pattern itself ends a match there).
_CUT = re.compile(r"(?<=\S)(?=[ \n])|(?<=\s)(?=[ \n]\S)")


def encoding(ranks_path: str, pattern: str):
    """The tiktoken encoding of a rank file; made once per task."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Pieces of about ``size`` characters or, where no safe cut exists, longer."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(text: str | None, enc, size: int = PIECE_CHARS) -> list[int]:
    if not text:
        return []
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for piece in safe_pieces(text, size) for i in enc.encode_ordinary(piece)]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, n_tokens`` for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            for part in _parts(batch):
                ids = [encode_text(t, enc) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64())],
                    ["doc_id", "ids", "n_tokens"])

    return docs.select(docs["doc_id"].cast("long"), docs[text]).mapInArrow(
        run, "doc_id long, ids array<int>, n_tokens long")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, raw binary`` from ``doc_id, ids``: the bytes, also where they are not UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            raw = [enc.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode, decode and digest in one pass: ``doc_id, n_tokens, ids_sha256,
    decoded_sha256`` and, if asked for, ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        names = [str(i) for i in range(enc.n_vocab)]
        for batch in batches:
            for part in _parts(batch):
                all_ids = [encode_text(t, enc) for t in part.column(1).to_pylist()]
                ids_sha = [hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest() for ids in all_ids]
                raw_sha = [hashlib.sha256(enc.decode_bytes(ids)).hexdigest() for ids in all_ids]
                columns = [part.column(0), pa.array(map(len, all_ids), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())]
                if with_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][:len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(docs["doc_id"].cast("long"), docs[text]).mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time as Python objects, so memory follows the texts, not the batch."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
