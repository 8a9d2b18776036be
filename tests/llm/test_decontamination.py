import hashlib
import re

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType
from util import AWKWARD, frame, prose

from tidepool.llm import decontamination as D

ITEMS = StructType([StructField("item_id", LongType()), StructField("text", StringType()), StructField("n_hit", StringType())])
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items, window=10):
    owners = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            owners.setdefault(tuple(w[k:k + n]), set()).add(item)
    out = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in owners}:
            for k in range(len(w) - n + 1):
                if (own := owners.get(tuple(w[k:k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= {str(i) for i in own if i is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(map(repr, out))


def run(spark, rows, items, **options):
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    got = D.report(frame(spark, rows, "n_hit", "item_id", "text_key"), bench, **options).collect()
    return sorted(map(repr, map(tuple, got)))


def passage(seed, n=30):
    return prose(seed, n, prefix="Wö")


@pytest.fixture(scope="module")
def cases():
    shared = passage(1)
    items = [(1, shared), (10, shared), (2, passage(2)), (2, passage(2)), (3, "only four words here"), (4, "Nein"), (5, ""), (6, None),
             (None, passage(7)), (8, passage(8, 9)), (11, passage(11, 10)), (12, " ".join(passage(2).split()[5:25]))]
    rows = [(100 + i, f"{prose(50 + i, 40)}, {shared.upper().replace('Ö', 'ö')}! {prose(90 + i, 30)}") for i in range(5)]
    rows += [(200, " ".join(shared.split()[3:12])), (201, " ".join(shared.split()[3:13])), (202, passage(7)), (203, "but ONLY four-words here, nein"),
             (204, passage(8, 9) + " " + passage(11, 10)), (205, passage(2) + "\n" + passage(2)), (206, " ".join(passage(2).split()[::-1])),
             (207, "x" * 300 + " " + passage(11, 10)), (100, rows[0][1]), (None, rows[1][1])]
    return [(r[0], r[1]) for r in AWKWARD] + rows, items


def test_equals_brute_force(spark, cases):
    rows, items = cases
    assert run(spark, rows, items) == brute(rows, items)


@pytest.mark.parametrize("window,gram", [(10, 1), (10, 10), (7, 3), (1, 1)])
def test_other_windows(spark, cases, window, gram):
    rows, items = cases
    rows = [r for r in rows if len(r[1] or "") < 10_000]
    assert run(spark, rows, items, window=window, gram=gram) == brute(rows, items, window)


def test_long_texts_are_read_in_pieces(spark, cases, monkeypatch):
    raw = (prose(5, 3000) + " " + passage(2) + " " + prose(6, 3000) + " " + "y" * 5000 + " " + passage(1) + " tail").encode()
    for piece in (1, 40, 777, 1 << 20):
        monkeypatch.setattr(D, "PIECE", piece)
        whole = words(raw.decode())
        seen = {}
        for part, before in D._pieces(raw, 9):
            seen.update({before + i: w for i, w in enumerate(words(part.decode()))})
        assert [seen[i] for i in range(len(whole))] == whole
    # spans at every place of a text of several pieces
    monkeypatch.setattr(D, "PIECE", 500)
    rows = [(i, prose(i, 90 + i) + " " + passage(1) + " " + prose(i + 60, 70)) for i in range(40)]
    items = [(1, passage(1)), (2, prose(0, 700, prefix="q"))]
    rows.append((99, prose(3, 60) + " " + items[1][1]))
    assert run(spark, rows, items) == brute(rows, items)


def test_spans_and_kept_rows(spark, cases):
    rows, items = cases
    docs, bench = frame(spark, rows, "row_key"), spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    hits = D.find(docs, bench)
    keys = {bytes(r["text_key"]): r["doc_id"] for r in hits.documents.filter("doc_id is not null and text_key is not null").collect()}
    got = {(keys[bytes(r["text_key"])], r["start"], r["end"]) for r in D.spans(hits).collect() if bytes(r["text_key"]) in keys}
    assert {s for s in got if s[0] in (201, 205)} == {(201, 0, 10), (205, 0, 60)}
    clean = D.keep_rows(docs, bench)
    assert clean.columns == docs.columns
    want = sorted(str(r[0]) for r, b in zip(rows, [brute([r], items) for r in rows]) if b[0].endswith("False)"))
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == want


def test_empty_tables(spark, cases):
    rows, items = cases
    assert run(spark, [], items) == []
    assert run(spark, rows, []) == brute(rows, [])
