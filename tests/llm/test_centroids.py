import hashlib

import numpy as np

from tidepool.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, c_cluster string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k, rounds, dimension):
    kept = [(i, [int(np.floor(1024 * np.float64(np.float32(c)))) for c in v]) for i, v in rows
            if v is not None and len(v) == dimension and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [r[1] for r in start[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        centers = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(centers)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    total = sum(d for _, _, d in found)
    return sorted(map(repr, ((i, j, d, sum(e for _, m, e in found if m == j), total,
                              hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for i, j, d in found)))


def run(spark, rows, k=8, rounds=10, dimension=4):
    return sorted(map(repr, map(tuple, C.report(frame(spark, rows), k=k, rounds=rounds, dimension=dimension).collect())))


def data(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.integers(0, 4, 4) + rng.standard_normal(4) / 10).astype(np.float32).tolist()) for i in range(n)]


def test_equals_brute_force(spark):
    rows = data(300) + [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(200)]
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0]), (2003, [float("nan")] * 4), (2004, [float("inf"), 0.0, 0.0, 0.0]),
             (2005, [1.0] * 5), (None, [0.25, 0.0, 0.0, 1.0]), (3, rows[3][1])]
    assert run(spark, rows) == brute(rows, 8, 10, 4)


def test_ties_and_few_vectors(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3), 0.0, 0.0]) for i in range(27)]          # many equal distances, equal centroids
    assert run(spark, grid, k=5, rounds=3) == brute(grid, 5, 3, 4)
    few = [(1, [0.0, 0.0, 0.0, 1.0]), (2, [0.0, 0.0, 0.0, 1.0]), (3, [1.0, 0.0, 0.0, 0.0])]
    assert run(spark, few) == brute(few, 8, 10, 4)
    assert run(spark, few, k=1) == brute(few, 1, 10, 4)
    assert run(spark, []) == []


def test_components_beyond_the_bound_are_left_out(spark):
    rows = data(20) + [(99, [3e30, 0.0, 0.0, 0.0]), (98, [131073.0, 0.0, 0.0, 0.0])]
    assert run(spark, rows) == brute(data(20), 8, 10, 4)


def test_orchard_equals_full_search():
    rng = np.random.default_rng(4)
    for k, d, spread in ((1, 3, 5), (2, 2, 2), (40, 3, 3), (64, 8, 100), (30, 1, 2)):
        centers, x = rng.integers(-spread, spread, (k, d)), rng.integers(-2 * spread, 2 * spread, (500, d))
        cluster, distance, measured = C.Orchard(centers).nearest(x)
        full = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
        assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
        assert measured <= 500 * k


def test_orchard_measures_less_than_all():
    rng = np.random.default_rng(5)
    centers = rng.integers(-10_000, 10_000, (200, 2))
    x = centers[rng.integers(0, 200, 2000)] + rng.integers(-20, 20, (2000, 2))
    assert C.Orchard(centers).nearest(x)[2] < 2000 * 200 / 4


def test_largest_components():
    top = C.LARGEST
    centers = np.array([[top] * 64, [-top] * 64, [0] * 64], np.int64)
    cluster, distance, _ = C.Orchard(centers).nearest(np.array([[-top] * 64, [top] * 64, [1] * 64], np.int64))
    assert cluster.tolist() == [1, 0, 2] and distance.tolist() == [0, 0, 64]
