import hashlib
import random

import pytest
from tests_llm_path import tokenizer
from util import AWKWARD, frame

from tidepool.llm import bpe

PATH, PATTERN = tokenizer()


@pytest.fixture(scope="module")
def enc():
    return bpe.encoding(PATH, PATTERN)


def test_round_trip_equals_the_library(spark, enc):
    rows = AWKWARD + [(20, "I'll don't  go\n\n  there 123,456 !! x y <|endoftext|> 🙂🙂")]
    got = bpe.round_trip(frame(spark, rows, "ids", "n_tokens"), PATH, PATTERN).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = enc.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_pieces_do_not_change_ids(enc):
    rng = random.Random(7)
    alphabet = ["a", "b", "é", "1", " ", " ", "  ", "\n", "\t", "\r\n", ".", "'s", " ", "\x1c", "漢"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(120)))
        for size in (1, 3, 10):
            assert "".join(bpe.safe_pieces(text, size)) == text
            assert bpe.encode_text(text, enc, size) == enc.encode_ordinary(text), repr(text)


def test_long_runs(enc):
    for text in (" " * 300_000 + "a", "a" * 100_000, "\n" * 200_000, "1 " * 100_000):
        ids = bpe.encode_text(text, enc)
        assert enc.decode_bytes(ids) == text.encode()


def test_encode_then_decode(spark):
    docs = frame(spark, AWKWARD)
    encoded = bpe.encode(docs, PATH, PATTERN)
    assert encoded.filter("n_tokens <> size(ids)").count() == 0
    raw = {(r["doc_id"], bytes(r["raw"])) for r in bpe.decode(encoded, PATH, PATTERN).collect()}
    assert raw == {(i, (t or "").encode()) for i, t, *_ in AWKWARD}
    assert bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0
