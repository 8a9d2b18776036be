import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from util import AWKWARD, frame, prose

from tidepool.llm import near_dedup as N
from tidepool.llm.connected import components


def sets_of(rows, words):
    out = []
    for _, t, *_ in rows:
        w = [x.lower() for x in (t or "").encode().split()]
        out.append({tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    return out


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, words, percent=80):
    rows = [r for r in rows if r[0] is not None]
    sets = sets_of(rows, words)
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = roots([r[0] for r in rows], links)
    return sorted((r[0], len(s), root[r[0]], root[r[0]] == r[0]) for r, s in zip(rows, sets))


def variants():
    rng = random.Random(9)
    rows = []
    for group in range(12):
        base = prose(group, 120, 5_000).split()
        for copy in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10 ** 6)}"
            rows.append(" ".join(w))
    # a chain: neighbours are alike, the ends are not
    chain = prose(77, 200, 9_000).split()
    for k in range(8):
        rows.append(" ".join(chain[k * 8:k * 8 + 130]))
    # half alike: candidates that the sets refute
    half = prose(78, 60, 9_000)
    rows += [half + " " + prose(200 + k, 45, 9_000) for k in range(25)]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("words", "block"), [(4, 256), (5, 4)])
def test_against_brute_force(spark, monkeypatch, words, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = variants() + [(1000 + (i or 0), t) for i, t, *_ in AWKWARD if i] + [(2000, "SAME Text"), (2001, "same text"), (2002, "Änd"), (2003, "änd")]
    got = N.near_groups(frame(spark, rows, "rep", "band", "component"), words=words)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, words)


def test_rows_kept_and_nulls(spark):
    rows = variants() + [(None, "no id"), (None, "no id"), (None, None)]
    docs = frame(spark, rows, "gone_id", "row")
    got = N.keep_rows(docs, words=5)
    assert got.schema == docs.schema
    want = [r[0] for r in brute(rows, 5) if r[3]]
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == want
    assert got.filter("doc_id is null").count() == 3
    assert N.near_groups(docs.limit(0)).count() == 0 and N.keep_rows(docs.limit(0)).count() == 0


def test_many_near_copies(spark):
    """A group whose members differ from each other costs links to its head, not all pairs."""
    base = prose(1, 300, 9_000)
    rows = [(i, f"{base} x{i} y{i}") for i in range(400)]
    got = N.near_groups(frame(spark, rows)).agg(F.countDistinct("component_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (1, 1)


def test_signatures_are_superminhash():
    """Against the sequential algorithm: each item permutes the positions, place j offers j + r."""
    rng = np.random.default_rng(0)
    size = 16
    sets = [np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64)) for n in (0, 1, 3, 40, 400)]
    got = N.signatures(sets, size)
    for s, h in zip(sets, got):
        want = [np.inf] * size
        for item in s:
            p = list(range(size))
            for j in range(size):
                draw = N._mix(np.array([item]) + np.uint64((j + 1) * int(N._C[0]) % 2 ** 64))
                r = float(draw[0] >> np.uint64(11)) * 2.0 ** -53
                k = j + int(N._mix(draw)[0] % np.uint64(size - j))
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], j + r)
        assert h.tolist() == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        both, a, b = (rng.integers(0, 2 ** 63, n, dtype=np.uint64) for n in (80, 10, 10))
        sig = N.signatures([np.unique(np.concatenate([both, x])) for x in (a, b)], 128)
        errors.append((sig[0] == sig[1]).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.0354     # below that of plain MinHash


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)] + [(0, 500 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for link in links for x in link}, links)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_that_only_blocks_can_find(spark):
    """The head of a bucket refutes both, but the two are alike."""
    found = defaultdict(int)
    for seed in range(3):
        core = prose(seed, 90, 9_000)
        rows = [(0, core + " " + prose(50 + seed, 60, 9_000))] + [(k, core + " " + prose(60 + seed, 25, 9_000) + f" z{k}") for k in range(1, 6)]
        got = sorted(tuple(r) for r in N.near_groups(frame(spark, rows), words=4).collect())
        assert got == brute(rows, 4)
        found[len({r[2] for r in got})] += 1
    assert found[2] == 3
