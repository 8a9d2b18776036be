import hashlib
import random
import zlib

from util import AWKWARD, frame

from tidepool.llm import sharding as S


def best(sizes, shards):
    def fits(cap):
        used, at = 1, 0
        for s in sizes:
            if s > cap:
                return False
            if at + s > cap:
                used, at = used + 1, 0
            at += s
        return used <= shards

    low, high = 0, sum(sizes)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def check(spark, rows, shards=8):
    got = [r.asDict() for r in S.assign(frame(spark, rows, "shard", "bucket", "end"), shards).collect()]
    assert len(got) == len(rows)
    key = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    group = {}
    for _, t, *_ in rows:
        group[key(t)] = group.get(key(t), 0) + len((t or "").encode()) + 1
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows if i is not None)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == want
    crc = {}
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        assert crc.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]      # equal texts together
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    load = [sum(r["size"] for r in got if r["shard"] == s) for s in range(shards)]
    assert max(load) == best([group[k] for k in sorted(group)], shards)


def test_best_partition(spark):
    rng = random.Random(2)
    check(spark, [(i, "t" * rng.randrange(1, 300) + str(i)) for i in range(300)])


def test_awkward_rows_and_a_hot_group(spark):
    check(spark, AWKWARD + [(100 + i, "hot text") for i in range(300)] + [(500 + i, f"n{i}") for i in range(20)])


def test_fewer_groups_than_shards_and_none(spark):
    check(spark, [(1, "a"), (2, "bb"), (3, None)])
    assert S.assign(frame(spark, [(1, "a")]).limit(0)).count() == 0
