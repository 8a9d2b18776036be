"""Whitening of embeddings by spectral divide and conquer on QDWH polar factors.

Every entry c becomes the whole number ``x = floor(64 * c) + 1000000``.  The fit list holds
each distinct x vector once.  Spark gathers its size n, its sums S and, centred
at the rounded means before multiplying, the sums of products, all in whole numbers
(decimals), so that they are exact and do not depend on the order of tasks.

The covariance (dimension x dimension, whatever the number of rows) is split on the
driver: the polar factor U of ``V - shift * I``, found by the dynamically weighted Halley
iteration in its QR form (Nakatsukasa and Higham 2013), gives the spectral projector
``(U + I) / 2`` of the eigenvalues above the shift.  Orthonormal bases of its range and of
the complement split the matrix in two invariant blocks, and each is split again until a
block is one row or a multiple of the identity.  The mean of a block's diagonal as
shift lies strictly between its least and largest eigenvalue, so every split divides.

The matrix of at most ``components`` columns, sent to all tasks, then whitens every
row where it is.

Defined results: rows whose vector is null, or holds null or non-finite entries, are left
out, and so are empty vectors; where vectors differ in length, the length of most rows (the longer
at a tie) is the dimension and other rows are left out; rows without vec_id and
repeated rows get results like others, and repeated vectors count once in the fit; equal
eigenvalues leave the components inside their space arbitrary, but the same for all
rows; the entry of a component with the largest size is positive.  A component without variance (at
most 1e-14 of the largest eigenvalue per dimension, as in a table with one vector) cannot be
scaled: its ``whitened`` is null and it is left out of ``identity_error``; ``explained`` is null if nothing
varies.  ``deviation`` is null where it does not fit a long, and entries whose x does not fit 52 bits are
cut to that size.  Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import staged

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
LARGEST = 1 << 52            # of an x
EPS = np.finfo(float).eps
_EXACT = 1 << 53             # whole numbers that a double holds


def finite_vector(vector: str) -> Column:
    """Whether an array is there, has entries, and all of them are finite numbers."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False))


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``vec_id, x`` of the rows with finite vectors of the most frequent length."""
    kept = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter(finite_vector("v"))

    def whole(c: Column) -> Column:
        bound = F.lit(float(LARGEST))
        return F.floor(F.greatest(-bound, F.least(bound, c.cast("double") * scale))).cast("long") + offset

    kept = staged(kept.select("vec_id", F.transform("v", whole).alias("x")), "whole")
    width = kept.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return kept.filter(F.size("x") == (width["width"] if width else 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of whole numbers, exact (Python integers)."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    largest = int(np.abs(y).max(initial=0))
    rows = _EXACT // max(1, largest * largest)           # whose sums a double holds exactly
    if not rows:
        return y.astype(object).T @ y.astype(object)
    for at in range(0, len(y), rows):
        part = y[at:at + rows].astype(float)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _products(center: list[int]):
    """Per task: sums of products of the centred vectors, upper triangle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, total = np.array(center, np.int64), 0
        for batch in batches:
            if batch.num_rows:
                total = total + exact_products(_matrix(batch.column(0)) - c)
        if not np.isscalar(total):
            i, j = np.triu_indices(len(c))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                              pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))], ["i", "j", "p"])
    return run


class Covariance(NamedTuple):
    """Of the fit list: size, sums, covariance (each entry rounded once)."""

    n: int
    sums: list[int]
    matrix: np.ndarray


def covariance(fit: DataFrame) -> Covariance | None:
    """``fit``: distinct vectors ``x`` of one length.  Gathers ``dimension ** 2`` numbers at most."""
    sums = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    rows = sorted(sums.collect())
    if not rows:
        return None
    n, s = rows[0]["n"], [int(r["s"]) for r in rows]
    center = [(2 * v + n) // (2 * n) for v in s]
    rest = [v - n * c for v, c in zip(s, center)]        # sums of the centred vectors: at most n / 2
    found = fit.select("x").mapInArrow(_products(center), "i int, j int, p decimal(38,0)").groupBy("i", "j").agg(F.sum("p").alias("p"))
    matrix = np.zeros((len(s), len(s)))
    for r in found.collect():
        i, j = r["i"], r["j"]
        matrix[i, j] = matrix[j, i] = float(Fraction(n * int(r["p"]) - rest[i] * rest[j], n * n))
    return Covariance(n, s, matrix)


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QDWH."""
    size = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(max(low * 0.9, EPS), 1.0)                  # a lower bound of the least singular value
    for _ in range(30):
        if abs(low - 1) < 10 * EPS:
            break
        d = np.cbrt(4 * (1 - low * low) / low ** 4)
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * root))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        low = min(1.0, low * (p + q * low * low) / (1 + r * low * low))
        basis = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(size)]))[0]
        new = q / r * x + (p - q / r) / np.sqrt(r) * basis[:size] @ basis[size:].T
        x = (new + new.T) / 2
    return x


def _range(projector: np.ndarray, rank: int) -> np.ndarray:
    """Orthonormal basis of the range of a spectral projector."""
    start = np.random.default_rng(len(projector)).standard_normal((len(projector), rank))
    basis = np.linalg.qr(projector @ start)[0]
    return np.linalg.qr(projector @ basis)[0]


def spectral_split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the invariant subspaces of a symmetric matrix with eigenvalues above and below
    the mean of the diagonal."""
    size, unit = len(a), np.eye(len(a))
    shift = np.trace(a) / size
    reach = np.linalg.norm(a - shift * unit) / size
    for attempt in range(1, 20):
        projector = (polar_factor(a - shift * unit) + unit) / 2
        above = round(np.trace(projector))
        if 0 < above < size:
            high, low = _range(projector, above), _range(unit - projector, size - above)
            if np.linalg.norm(low.T @ a @ high) <= 20 * size * EPS * np.linalg.norm(a):
                return high, low
        # an eigenvalue lies on the shift, to the last digits: move it a little
        shift += (-1) ** attempt * attempt * reach / 64
    raise ArithmeticError("no split found")


def eigen(a: np.ndarray, floor: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of a symmetric matrix."""
    size = len(a)
    floor = size * EPS * np.linalg.norm(a) if floor is None else floor
    mean = np.trace(a) / size
    if size == 1 or np.linalg.norm(a - mean * np.eye(size)) <= floor:
        return np.diag(a).copy(), np.eye(size)
    values, vectors = [], []
    for basis in spectral_split(a):
        block = basis.T @ a @ basis
        e, v = eigen((block + block.T) / 2, floor)
        values.append(e)
        vectors.append(basis @ v)
    values, vectors = np.concatenate(values), np.hstack(vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


class Whitener(NamedTuple):
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray           # eigenvalues of the components, falling
    vectors: np.ndarray          # dimension x components
    usable: np.ndarray           # of the components: whether they have variance


def whitener(cov: Covariance, components: int = COMPONENTS) -> Whitener:
    values, vectors = eigen(cov.matrix)
    peak = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[peak, np.arange(len(values))] < 0, -1.0, 1.0)
    usable = values > max(0.0, float(values[0])) * len(values) * 1e-14
    return Whitener(cov.n, cov.sums, float(np.trace(cov.matrix)), values[:components], vectors[:, :components], usable[:components])


def _centred(x: np.ndarray, w: Whitener) -> tuple[np.ndarray, np.ndarray]:
    """``n * x - S`` exact (long, or Python integers where a long is too small) and ``x - S / n``."""
    sums = np.array(w.sums, object)
    fits = max(int(np.abs(x).max(initial=0)), 1) * w.n + max(map(abs, w.sums)) < 1 << 62
    off = w.n * x - sums.astype(np.int64) if fits else x.astype(object) * w.n - sums
    return off, (off / w.n).astype(float)


def _projected(x: np.ndarray, w: Whitener) -> tuple[np.ndarray, np.ndarray]:
    off, y = _centred(x, w)
    return off, (y @ w.vectors) / np.sqrt(np.where(w.usable, w.values, 1.0))


def _moments(w: Whitener):
    """Per task: number, sums and products of the whitened fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                z = _projected(_matrix(batch.column(0)), w)[1]
                sums += z.sum(axis=0)
                products += z.T @ z
        i, j = np.triu_indices(k)
        rows = [*zip([-1] * k, range(k), sums), *zip(i.tolist(), j.tolist(), products[i, j])]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                          pa.array([float(r[2]) for r in rows])], ["i", "j", "p"])
    return run


def identity_error(fit: DataFrame, w: Whitener) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    found = fit.select("x").mapInArrow(_moments(w), "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p"))
    got = {(r["i"], r["j"]): r["p"] / w.n for r in found.collect()}
    error = 0.0
    for (i, j), p in got.items():
        if i >= 0 and w.usable[i] and w.usable[j]:
            error = max(error, abs(p - got[-1, i] * got[-1, j] - (i == j)))
    return error


def _whiten(w: Whitener, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        shares = [float(e / w.trace) if w.trace > 0 else None for e in w.values]
        for batch in batches:
            if not batch.num_rows:
                continue
            off, z = _projected(_matrix(batch.column(1)), w)
            largest = int(np.abs(off).max(initial=0))
            if largest * largest * off.shape[1] < 1 << 63:
                deviation = pa.array((off.astype(np.int64) ** 2).sum(axis=1))
            else:
                exact = (off.astype(object) ** 2).sum(axis=1)
                deviation = pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())
            m = len(z)
            row = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, w.n)), deviation.take(pa.array(row)), pa.array(z.ravel(), mask=~np.tile(w.usable, m)),
                pa.array(shares * m, pa.float64()), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector and component up to ``components``."""
    vectors = whole_vectors(rows, vec_id, vector)
    fit = staged(vectors.select("x").distinct(), "fit")
    cov = covariance(fit)
    if cov is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    w = whitener(cov, components)
    return vectors.mapInArrow(_whiten(w, identity_error(fit, w)), OUT)
