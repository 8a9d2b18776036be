import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F
from util import AWKWARD, frame

from tidepool.llm import exact_dedup as X


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep, done = max(ids, key=lambda i: (i is not None, i or 0)), False
        for i in ids:
            kept = i == keep and not done
            done = done or kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(map(repr, out))


def test_groups(spark):
    rows = AWKWARD + [(100 + i, f"copy {i % 7}") for i in range(200)] + [(1000 + i, "hot") for i in range(300)]
    got = X.exact_groups(frame(spark, rows, "digest", "kept", "n"))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows)


def test_rows_kept(spark):
    rows = AWKWARD + [(1000 + i, "hot") for i in range(50)]
    docs = frame(spark, rows, "row", "keep_id")
    got = X.keep_rows(docs)
    assert got.schema == docs.schema
    texts = [r["text"] or "" for r in got.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, *_ in rows})
    assert got.filter("text = 'hot'").first()["doc_id"] == 1049
    assert X.keep_rows(docs.limit(0)).count() == 0 and X.exact_groups(docs.limit(0)).count() == 0


def test_filter_takes_deletes_and_grows():
    rng = random.Random(1)
    live, f = defaultdict(int), X.CuckooFilter(buckets=4)
    for _ in range(20_000):
        key = rng.randrange(6_000) * 0x1234567
        if rng.random() < 0.4 and live[key]:
            assert f.delete(key)
            live[key] -= 1
        elif live[key] < 4:
            f.insert(key)
            live[key] += 1
    assert all(f.contains(k) for k, n in live.items() if n)
    assert not f.delete(-1)
    false = sum(f.contains(rng.getrandbits(64)) for _ in range(20_000))
    assert false < 60
    for k, n in list(live.items()):
        for _ in range(n):
            assert f.delete(k)
    assert not any(f.table) and not f.keys


def test_index_over_time(spark):
    def digests(pairs):
        return spark.createDataFrame(pairs, "doc_id long, text string").select("doc_id", X.digest_of(F.col("text")).alias("digest"))

    def read(index):
        return sorted((bytes(r["digest"]).hex()[:6], r["keep_id"], r["n"]) for r in index.collect())

    name = lambda t: hashlib.sha256(t.encode()).hexdigest()[:6]
    one = X.update_index(None, digests([(1, "a"), (2, "a"), (3, "b"), (9, "c")]))
    assert read(one) == sorted([(name("a"), 2, 2), (name("b"), 3, 1), (name("c"), 9, 1)])
    gone = digests([(0, "a"), (0, "never there")])
    two = X.update_index(one, digests([(5, "b"), (1, "a"), (7, "d")]), gone)
    assert read(two) == sorted([(name("a"), 1, 1), (name("b"), 5, 2), (name("c"), 9, 1), (name("d"), 7, 1)])


def test_many_keys_against_the_plain_answer(spark):
    """Enough keys for false positives and several doublings; deletes of a third of them."""
    n = 30_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.sha2((F.col("id") % 20_000).cast("string"), 256).alias("digest"))
    rows = rows.withColumn("digest", F.unhex("digest"))
    index = X.staged(X.update_index(None, rows), "t")
    assert index.count() == 20_000 and index.agg(F.sum("n")).first()[0] == n
    gone = rows.filter("doc_id % 3 = 0 and doc_id < 20000")
    after = X.update_index(index, rows.limit(0), gone)
    assert after.count() == 20_000 - gone.count()


def test_a_key_added_often_holds_one_slot():
    index = X.CuckooFilter(2)
    for _ in range(50):
        index.insert(12345)
    assert sum(1 for x in index.table if x) == 1
    for left in range(49, -1, -1):
        assert index.contains(12345) and index.delete(12345)
    assert not index.contains(12345) and not index.delete(12345)
