import zlib

from conftest_paths import SF_SMALL
from util import AWKWARD, frame

from tidepool.llm import language as L
from tidepool.llm.common import documents


def test_held_out_accuracy(spark):
    docs = documents(spark, SF_SMALL)
    got = {r["doc_id"]: r for r in L.predict(docs, L.train(docs)).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_labels_of_the_held_out_fold_do_not_count(spark):
    rows = [(i, ("the and of " if i % 2 else "der und die ") * 5 + str(i), "en" if i % 2 else "de") for i in range(80)]
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else g) for i, t, g in rows]
    docs = frame(spark, rows)
    a = sorted(map(tuple, L.predict(docs, L.train(docs)).collect()))
    b = sorted(map(tuple, L.predict(docs, L.train(frame(spark, wrong))).collect()))
    assert a == b and all(p == ("en" if i % 2 else "de") for i, _, p, _ in a)


def test_awkward_rows(spark):
    rows = [(100 + i, ("the and of " if i % 2 else "der und die ") * 5, "en" if i % 2 else "de") for i in range(40)] + AWKWARD + [(50, "12 34 !?", "en"), (51, "½ ² Ⅷ", "en")]
    docs = frame(spark, rows, "score", "h", "bits")
    got = L.predict(docs, L.train(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (1, 2, 3, 9, 50, 51):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (7, 8)} <= {"en", "de"}
    nothing = L.predict(docs, L.train(docs.filter("lang is null")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert L.predict(docs.limit(0), None).count() == 0 and L.train(docs.limit(0)) is None


def test_presence_is_of_the_whole_text():
    a, b = L.presence("abcd" * 10_000 + "xyz"), L.presence("abcd" * 10)
    assert (a & ~b).any() and not (b & ~a).any()


def test_scores_are_kernel_ridge_regression_by_hand(spark):
    """The kernel, the landmark features and the regression, spelled out over sets of n-grams."""
    import numpy as np

    rows = [(i, ("the and of " if i % 2 else "der und die ") * 3 + "abcdefghij"[i % 10] * 4, "en" if i % 2 else "de") for i in range(60)]
    docs = frame(spark, rows)
    model = L.train(docs, per_language=12, landmarks=4)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(docs, model).collect()}

    def grams(text):
        return set(np.flatnonzero(L.presence(text)).tolist())

    def kernel(a, b):
        return len(a & b) / (len(a) * len(b)) ** 0.5

    h = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "xxhash64(cast(doc_id as string), 'language') as h").collect()}
    learn = {g: sorted((i for i, _, lang in rows if lang == g and zlib.crc32(str(i).encode()) % 4 != 2), key=h.get)[:12] for g in ("de", "en")}
    sets = {i: grams(t) for i, t, _ in rows}
    marks = [sets[i] for g in ("de", "en") for i in learn[g][:4]]
    order = [i for g in ("de", "en") for i in learn[g]]
    k_mm = np.array([[kernel(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(k_mm)
    keep = value > 1e-8
    features = vector[:, keep] / np.sqrt(value[keep])
    phi = np.array([[kernel(sets[i], m) for m in marks] for i in order]) @ features
    phi = np.hstack([phi, np.ones((len(phi), 1))])
    y = np.array([[1.0 if (g == "en") == (m == "en") else -1.0 for m in ("de", "en")] for g in ("de", "en") for _ in learn[g]])
    weights = np.linalg.solve(phi.T @ phi + L.RIDGE * len(order) / 2 * np.eye(phi.shape[1]) * 1e-2, phi.T @ y)
    for i, _, _ in rows:
        margin = np.append(np.array([kernel(sets[i], m) for m in marks]) @ features, 1.0) @ weights
        assert got[i][0] == ("de", "en")[int(margin.argmax())]
        assert abs(got[i][1] - min(1.0, max(0.0, (margin.max() + 1) / 2))) < 1e-4
