from collections import Counter

import corpus_pipeline as C
from util import AWKWARD, frame
from test_exact_dedup import brute as exact
from test_near_dedup import brute as near
from test_quality import base, corpus

from tidepool.llm import mixing, quality


def test_every_stage_on_what_the_one_before_kept(spark):
    rows = [(i, t, g, "ab"[i % 2]) for i, t, g in corpus()]
    rows += [(300 + i, rows[i][1], "en", "a") for i in range(5)] + [(400 + i, rows[i][1] + f" tail{i}", "en", "b") for i in range(10, 16)]
    rows += [((i and i + 9_000), *r) for i, *r in AWKWARD]
    docs = frame(spark, rows, "kept", "row")
    states = [docs]
    for _, stage in C.STAGES:
        states.append(C.staged(stage(spark, states[-1], ""), "t"))
    raw, good, single, far, mixed, coded = states
    assert all(s.schema.names == docs.schema.names for s in states[:-1])

    verdict = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(i for i, t, *_ in rows if verdict[i])
    assert not any(base(r["text"])[5] for r in good.collect())

    left = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert sorted(repr(r["doc_id"]) for r in single.collect()) == sorted(x[1:].split(",")[0] for x in exact(left) if "True" in x)

    left = [(r["doc_id"], r["text"]) for r in single.collect()]
    assert sorted(r["doc_id"] for r in far.collect()) == [r[0] for r in near(left, 5) if r[3]]

    taken = {r["doc_id"]: r for r in mixing.mix(far).collect()}
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert all(times.get(i, 0) == int(r["taken"] / r["size"] + 0.5) for i, r in taken.items())
    assert sum(r["size"] * times.get(i, 0) for i, r in taken.items()) > 1.3 * sum(r["size"] for r in taken.values())

    assert Counter((r["doc_id"]) for r in coded.collect()) == times
    assert all(r["n_tokens"] == len(r["ids"]) for r in coded.collect())


def test_run_and_empty(spark, tmp_path):
    frame(spark, [(i, t, g, "a") for i, t, g in corpus()]).write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() > 100
    empty = tmp_path / "none"
    frame(spark, AWKWARD).limit(0).write.parquet(str(empty / "documents.parquet"))
    assert C.run(spark, str(empty)).count() == 0
