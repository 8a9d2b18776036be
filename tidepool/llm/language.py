"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (1 to ``SPECTRUM``
characters, lower case) that both contain, whatever their frequency, over the
geometric mean of the numbers that each contains: the blended-spectrum presence
kernel.  Landmark documents stand for the kernel matrix (Nystroem), on whose
features one ridge regression per language is fitted against the rest.  Scoring
is two matrix products per batch: presence times landmarks, kernel values times
coefficients.

N-grams are hashed to ``BINS`` bins; only bins that a landmark has enter the
product.  Training takes at most ``PER_LANGUAGE`` documents per language, by hash
of the doc_id, of which the first ``LANDMARKS`` are landmarks: the model's size and
the sample depend on the number of languages alone.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as
is every text if there is nothing to learn from; a null doc_id counts as the empty
text in the fold and does not train; repeated rows are predicted alike; an empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPECTRUM = 3
BINS = 1 << 15
PER_LANGUAGE = 400
LANDMARKS = 32
RIDGE = 1e-2
HELD_OUT = 2
UNKNOWN = "und"
_MUL = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def presence(text: str) -> np.ndarray:
    """Which bins the n-grams of the whole text fall in."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    seen = np.zeros(BINS, bool)
    total = np.zeros(len(points), np.uint32)
    for n in range(min(SPECTRUM, len(points))):
        total = (total[:len(points) - n] ^ points[n:]) * _MUL[n]
        total ^= total >> np.uint32(15)
        seen[(total * _MUL[3]) >> np.uint32(32 - 15)] = True
    return seen


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(r["lang"], r["h"], np.packbits(presence(r["text"])).tobytes())
                for r in batch.to_pylist() if has_letter(r["text"])]
        lang, h, bits = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(h, pa.int64()), pa.array(bits, pa.binary())],
                                         ["lang", "h", "bits"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE,
          text: str = "text") -> dict | None:
    """The model, from labelled documents outside the held-out fold."""
    rows = docs.select("doc_id", "lang", F.col(text).alias("text")).filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # a share of each language's hash range, with room for chance and texts without letters
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit("language"))
    share = {lang: min(1.0, 1.5 * per_language / n) for lang, n in counts.items()}
    limit = F.create_map(*[x for lang, s in share.items() for x in (F.lit(lang), F.lit(min(2 ** 63 - 1, int((2 * s - 1) * 2 ** 63))))])
    picked = rows.withColumn("h", h).filter(F.col("h") <= limit[F.col("lang")])
    picked = picked.groupBy("lang", "h").agg(F.min("text").alias("text"))   # a document that is repeated comes once
    by_lang: dict[str, list] = {}
    for r in sorted(picked.mapInArrow(_sets, "lang string, h long, bits binary").collect(), key=lambda r: (r["lang"], r["h"], r["bits"])):
        by_lang.setdefault(r["lang"], []).append(np.unpackbits(np.frombuffer(r["bits"], np.uint8)))
    by_lang = {lang: sets[:per_language] for lang, sets in by_lang.items()}
    names = sorted(by_lang)
    if not names:
        return None
    marks = np.array([s for n in names for s in by_lang[n][:landmarks]], np.float32)
    x = np.array([s for n in names for s in by_lang[n]], np.float32)
    y = np.array([[1.0 if n == m else -1.0 for m in names] for n in names for _ in by_lang[n]])
    root = np.sqrt(marks.sum(axis=1))

    def kernel(a: np.ndarray) -> np.ndarray:
        return (a @ marks.T).astype(float) / np.outer(np.sqrt(a.sum(axis=1)), root)

    value, vector = np.linalg.eigh(kernel(marks))
    value, vector = value[value > 1e-8], vector[:, value > 1e-8]
    features = vector / np.sqrt(value)
    phi = np.hstack([kernel(x) @ features, np.ones((len(x), 1))])
    gram = phi.T @ phi + ridge * len(x) / len(names) * np.eye(phi.shape[1]) * 1e-2
    weights = np.linalg.solve(gram, phi.T @ y)
    used = np.flatnonzero(marks.any(axis=0))
    return {"names": names, "used": used, "marks": np.ascontiguousarray(marks[:, used].T), "root": root,
            "coefficients": features @ weights[:-1], "bias": weights[-1]}


def _predict(model: dict | None):
    def scores(texts: list[str]) -> list[tuple[str, float]]:
        sets = np.array([presence(t) for t in texts])
        x = sets[:, model["used"]].astype(np.float32)
        kernel = (x @ model["marks"]) / np.outer(np.sqrt(sets.sum(axis=1)), model["root"])
        margin = kernel @ model["coefficients"] + model["bias"]
        best = margin.argmax(axis=1)
        return [(model["names"][b], float(min(1.0, max(0.0, (m[b] + 1) / 2)))) for b, m in zip(best, margin)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(2).to_pylist()
                out = [(UNKNOWN, 0.0)] * len(texts)
                known = [i for i, t in enumerate(texts) if t and has_letter(t)] if model else []
                if known:
                    for i, found in zip(known, scores([texts[i] for i in known])):
                        out[i] = found
                lang, score = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 ["doc_id", "held_out", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"),
                       F.col(text).alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
