import random

import duckdb
import pytest
from compare import rows as canon
from util import AWKWARD, frame

from tidepool.llm import mixing as M
from tidepool.llm.oracle import ORACLE


def fixture():
    rng = random.Random(3)
    rows = [(100 + i, "w " * rng.randrange(1, 40), "en", rng.choice(["hot"] * 5 + ["b", "ä", "z", None])) for i in range(400)]
    return rows + AWKWARD + [(900, "tiny", "en", "y"), (901, "", "en", "empty")]


def test_against_sql(spark):
    docs = frame(spark, fixture(), "key", "size", "taken", "bucket")
    got = M.mix(docs).select("doc_id", "size", "source_size", "target", "taken")
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    con.execute("CREATE TABLE d AS SELECT doc_id::BIGINT AS doc_id, text, source FROM documents")
    cur = con.execute(ORACLE["op2_mixing"].replace("FROM documents", "FROM d"))
    names = [c[0] for c in cur.description]
    assert canon(got.columns, [tuple(r) for r in got.collect()]) == canon(names, cur.fetchall())


def test_laws(spark):
    rows = M.mix(frame(spark, fixture())).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by.setdefault(r["source"], [r["target"], 0, 0])
        s[1] += r["taken"]
        s[2] += r["size"]
    assert sum(t for t, _, _ in by.values()) == pytest.approx(1.5 * total)
    for target, taken, size in by.values():
        assert abs(target - taken) < 1 and target <= 2 * size + 1e-6


def test_targets_fill_by_weight(spark):
    rng = random.Random(5)
    for _ in range(4):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 500, 5000]) for i in range(rng.randrange(1, 9))} | {None: 7}
        got = {r["source"]: r["target"] for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        budget, closed, want = 1.5 * sum(sizes.values()), set(), {}
        while True:
            level = (budget - sum(2 * sizes[s] for s in closed)) / max(1, sum(weight[s] for s in order if s not in closed))
            want = {s: 2 * sizes[s] if s in closed else level * weight[s] for s in order}
            over = {s for s in order if want[s] > 2 * sizes[s] + 1e-9}
            if not over:
                break
            closed |= over
        assert got == pytest.approx(want)


def test_rows_repeat(spark):
    docs = frame(spark, fixture(), "r_id", "row", "t_nth")
    got = M.take_rows(docs)
    assert got.schema == docs.schema
    whole = {i: t for i, t, *_ in fixture() if t}
    taken = {}
    for r in got.collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
        assert r["text"] == whole[r["doc_id"]]
    for r in M.mix(docs).collect():
        if r["doc_id"] is not None and r["doc_id"] >= 100 and r["taken"] in (0, r["size"], 2 * r["size"]):
            assert taken.get(r["doc_id"], 0) * r["size"] == r["taken"]
    assert M.take_rows(docs.limit(0)).count() == 0 and M.mix(docs.limit(0)).count() == 0


def test_null_text_has_no_words_without_ansi(spark):
    from tidepool.llm.common import n_words
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(None,), ("",), (" a b\n",)], "text string").select(n_words(F.col("text")).alias("n"))
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert sorted(r["n"] for r in rows.collect()) == [0, 0, 2]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
