import hashlib
import random

import numpy as np
import pytest
from util import AWKWARD, frame, prose

from tidepool.llm import repeats as R
from tidepool.llm import suffixes as S


def brute(rows, width):
    """Rows (doc_id, text) in order of doc_id; rows without doc_id are left as they are."""
    seen, out, done = set(), [], {}
    for i, t in sorted({(i, t) for i, t, *_ in rows if i is not None}, key=lambda r: (r[0], r[1] or "")):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - width + 1):
            w = raw[k:k + width]
            if w in seen:
                gone[k:k + width] = b"\1" * width
            seen.add(w)
        left = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        done[i] = (i, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest())
    for i, t, *_ in rows:
        raw = (t or "").encode()
        out.append(done[i] if i is not None else (None, len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
    return sorted(map(repr, out))


def passages():
    rng = random.Random(4)
    parts = [prose(k, 30) for k in range(12)]
    rows = [(i, " ".join([prose(1000 + i, rng.randrange(3, 25)), rng.choice(parts), prose(2000 + i, 5), rng.choice(parts)[rng.randrange(40):]])) for i in range(60)]
    rows += [(100 + i, parts[0] + f" tail {i} " + parts[1]) for i in range(30)]
    rows += [(200, "ab" * 500), (201, "ab" * 300 + "c"), (202, "é" * 200), (203, parts[3] + parts[3]), (204, parts[2][:100]), (205, parts[2][:99])]
    return rows


@pytest.mark.parametrize("hot", [10_000, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(R, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(R, "BLOCK_BYTES", 3_000)
    rows = passages() + [(i and i + 5000, t) for i, t, *_ in AWKWARD]
    got = R.without_repeats(frame(spark, rows, "runs", "start", "spots"))
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows, R.WIDTH)


def test_text_left_and_empty(spark):
    docs = frame(spark, [(1, "x" * 10 + "0123456789" * 12), (2, "y" * 7 + "0123456789" * 12)])
    got = {r["doc_id"]: bytes(r["kept"]) for r in R.without_repeats(docs, with_text=True).collect()}
    assert got == {1: b"x" * 10 + b"0123456789", 2: b"y" * 7}
    assert R.without_repeats(docs.limit(0)).count() == 0


def test_text_longer_than_a_buffer(spark, monkeypatch):
    monkeypatch.setattr(R, "BUFFER", 1 << 12)
    long = prose(1, 3_000, 100_000)
    rows = [(1, long), (2, prose(2, 40) + long[5_000:9_000] + prose(3, 40)), (3, long[-4_000:])]
    got = R.without_repeats(frame(spark, rows))
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows, R.WIDTH)


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for small in (S.SMALL_ALPHABET, 2):
        S.SMALL_ALPHABET, kept = small, S.SMALL_ALPHABET
        try:
            for _ in range(300):
                t = rng.integers(0, rng.integers(1, 5) + 1, rng.integers(1, 120))
                sa = S.suffix_array(t)
                order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
                assert sa.tolist() == order
                shared = S.common_prefixes(t, sa, 12)
                for x, y in zip(order, order[1:]):
                    n = 0
                    while n < 12 and max(x, y) + n < len(t) and t[x + n] == t[y + n]:
                        n += 1
                    assert shared[y] == n
        finally:
            S.SMALL_ALPHABET = kept


def test_anchors_travel_packed():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = np.empty(2_000, R._ANCHOR)
    rows["anchor"] = rng.integers(0, 1 << 64, len(rows), np.uint64)
    rows["doc"], rows["start"] = 1_000_000 + rng.integers(0, 10_000, len(rows)), rng.integers(0, 3_000, len(rows))
    rows["n"] = rng.integers(1, 70, len(rows))
    rows["doc"][:3] = [-(1 << 63), (1 << 63) - 1, -1]
    back = R._unpack(R._pack(rows))
    assert sorted(back.tolist()) == sorted(rows.tolist())
    assert len(R._unpack(R._pack(rows[:0]))) == 0
    # eight random bytes of anchor, and less than six for the rest of the 26
    assert len(pa.compress(R._pack(rows), codec="lz4_raw", asbytes=True)) < 14 * len(rows)
