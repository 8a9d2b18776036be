"""Centroid clustering (Lloyd's rounds) with Orchard's search for the nearest centroid.

Orchard's algorithm (1991): every centroid has a list of the others, sorted by their
distance from it.  A vector starts at a centroid and walks its list; a centroid not yet
visited is measured, and as soon as one is closer, the walk goes on in that one's list from
the start.  It stops at the first entry whose distance from the current
centroid is strictly beyond twice the vector's distance: by the triangle
inequality nothing from there on can be as near.  At exactly twice the distance the entry may be
equally near, and of equally near centroids the smaller number wins.

Components are whole numbers ``floor(scale * component)``, so distances, sums and means
are exact and do not depend on the order of tasks.  All vectors of a batch walk in lockstep, as
arrays.  A round is one Spark job: tasks add up their vectors per centroid, and one row per task and
centroid is shuffled.  The driver holds the centroids and their lists, ``k * (k + dimension)`` numbers,
never a vector of the data beyond the first ``k``.

Defined results: vectors that are null, have another number of components or hold null or
non-finite ones are left out, as are those with a component beyond ``LARGEST / scale``, whose
squared distances do not fit a long; with fewer than ``k`` vectors each is a first centroid, repeated rows
included (empty clusters keep theirs); a missing vec_id counts as the empty string in the
choice of the first centroids, and rows of equal hash are chosen by their components; repeated rows are
assigned alike; further columns are ignored; an empty table gives an empty result.  Sums that do not fit a
long are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import staged
from tidepool.llm.whitening import finite_vector

K, ROUNDS, DIMENSION, SCALE, SEED = 8, 10, 64, 1024, 3
LARGEST = 1 << 27            # of a whole component: 64 squared differences fit a long
STEP = 4096                  # vectors that walk together


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


class Orchard:
    """Search structure of some centroids (k x dimension, whole numbers)."""

    def __init__(self, centroids: np.ndarray):
        k = len(centroids)
        self.centroids = centroids
        self.gaps = np.array([squared(centroids, c) for c in centroids]).reshape(k, k)
        others = [[j for j in np.lexsort((np.arange(k), self.gaps[i])) if j != i] for i in range(k)]
        self.lists = np.array(others, np.int64).reshape(k, k - 1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each vector the nearest centroid, the squared distance, and the number of distances measured in all."""
        n, k = len(x), len(self.centroids)
        here = np.zeros(n, np.int64)
        best = squared(x, self.centroids[0])
        visited = np.zeros((n, k), bool)
        visited[:, 0] = True
        place = np.zeros(n, np.int64)
        measured = n
        going = np.arange(n) if k > 1 else np.empty(0, np.int64)
        while len(going):
            at = here[going]
            other = self.lists[at, place[going]]
            # gap > 4 * best, without overflow
            inside = (self.gaps[at, other] - 1) >> 2 < best[going]
            going, other = going[inside], other[inside]
            new = ~visited[going, other]
            rows, to = going[new], other[new]
            visited[rows, to] = True
            measured += len(rows)
            d = squared(x[rows], self.centroids[to])
            closer = (d < best[rows]) | ((d == best[rows]) & (to < here[rows]))
            place[going] += 1
            moved = rows[closer]
            here[moved], best[moved], place[moved] = to[closer], d[closer], 0
            going = going[place[going] < k - 1]
        return here, best, measured


def _steps(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _sums(centroids: np.ndarray):
    """Per task and centroid: number and componentwise sums of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for _, x in _steps(batches, 0):
            cluster = search.nearest(x)[0]
            for c in np.unique(cluster):
                sums[c] += x[cluster == c].sum(axis=0)
            counts += np.bincount(cluster, minlength=len(counts))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64()))],
                                         ["cluster", "n", "sums"])
    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for part, x in _steps(batches, 1):
            cluster, distance, _ = search.nearest(x)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])
    return run


def whole_vectors(rows: DataFrame, dimension: int = DIMENSION, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the rows that take part."""
    kept = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter(
        (F.size("v") == dimension) & finite_vector("v"))
    kept = kept.filter(F.forall("v", lambda c: F.abs(c.cast("double") * scale) <= F.lit(float(LARGEST))))
    return kept.select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return np.array([r["x"] for r in vectors.orderBy(F.sha2(name, 256), "x").limit(k).collect()], np.int64)


def next_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the means; empty clusters keep their centroids."""
    dimension = centroids.shape[1]
    found = vectors.select("x").mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>").groupBy("cluster").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dimension)])
    out = centroids.copy()
    for r in found.collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dimension)]
    return out


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED,
            vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every vector, and the final centroids."""
    vectors = staged(whole_vectors(rows, dimension, scale, vec_id, vector), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        last, centroids = centroids, next_centroids(vectors, centroids)
        if (last == centroids).all():                    # nothing will move any more
            break
    return staged(vectors.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "assigned"), centroids


def report(rows: DataFrame, **options) -> DataFrame:
    """One row per vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    assigned, centroids = cluster(rows, **options)
    per_cluster = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = {r["cluster"]: int(r["s"]) for r in per_cluster}
    fits = lambda v: v if v < 1 << 63 else None
    table = [(i, fits(inertia[i]), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
             for i, c in enumerate(centroids) if i in inertia]
    # one row per centroid
    facts = assigned.sparkSession.createDataFrame(table, "c_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), F.col("cluster") == F.col("c_cluster")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
