import re
from collections import Counter

import numpy as np
import pytest
from util import AWKWARD, frame

from tidepool.llm import quality as Q


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    marked = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i:i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), n < 50 or 100 * len(marked) > 50 * n)


def corpus():
    import random

    rng = random.Random(11)
    common = {"en": ["the", "of", "and", "to", "is"], "de": ["der", "und", "die", "ist", "für"]}
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        words = [rng.choice(common[lang]) if rng.random() < 0.4 else "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(3, 9))) for _ in range(150)]
        rows.append((i, " ".join(words).capitalize() + ".", lang))
    rows.append((200, " ".join(w.upper() + "!!" for w in rows[1][1].split()), "en"))
    rows.append((201, " | ".join("xqzj"[k % 4] * 3 + str(k) for k in range(120)), "de"))
    rows.append((202, "a b c\na b c\na b c d\n" * 30, "en"))
    rows.append((203, rows[4][1], None))
    rows.append((204, rows[4][1], "xx"))
    return rows


def test_base_counts_and_verdicts(spark):
    rows = corpus() + AWKWARD
    got = Q.judge(frame(spark, rows, "kept", "n_words", "_lang")).collect()
    want = sorted((repr(i), *base(t)) for i, t, *_ in rows)
    assert sorted((repr(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert kept == set(range(120)) | {203, 204}
    assert all(0 <= r["class_distance"] <= 1 for r in got if r["class_distance"] is not None)


def test_references_are_exact(spark):
    rows = corpus()
    old, Q.CHUNK_WORDS = Q.CHUNK_WORDS, 500     # many chunks: the two-pass count must not lose a word
    try:
        refs = Q.references(frame(spark, rows))
    finally:
        Q.CHUNK_WORDS = old
    assert set(refs) == {"en", "de"}
    for lang, (_, bins, counts) in refs.items():
        words, docs = Counter(), [t.encode().lower().split() for _, t, g in rows if g == lang]
        for tokens in docs:
            for w, n in Counter(tokens).items():
                words[Q.common_form(w)] += n * Q.SCALE // len(tokens)
        want = {w: n for w, n in words.items() if n >= Q.COMMON * len(docs) * Q.SCALE and Q._has_letter(w)}
        assert {w: counts[i] for w, i in bins.items()} == want
        assert counts.sum() == len(docs) * Q.SCALE


def test_foreign_words_of_natural_classes(spark):
    import random

    rng = random.Random(5)
    foreign = [(300 + i, " ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.choice([2, 3, 5, 6, 8]))) for _ in range(150)).capitalize() + ".",
                "en" if i % 2 else None) for i in range(8)]
    rows = corpus() + foreign
    got = {r["doc_id"]: r for r in Q.judge(frame(spark, rows)).collect()}
    assert all(got[i]["class_distance"] < Q.CLASS_LIMIT and got[i]["word_distance"] < Q.WORD_LIMIT and not got[i]["base_failed"] for i, *_ in foreign)
    kept = set(range(120)) | {203, 204}
    assert {i for i, r in got.items() if r["kept"]} == kept
    assert {r["doc_id"] for r in Q.keep_rows(frame(spark, rows)).collect()} == kept


def test_word_limits(spark):
    near = [(True, 128, 0.2 + k / 1000, "en") for k in range(41)]
    rows = (near + [(True, 128, 0.23, "en")] * 500 + [(False, 128, 0.4, "en")] * 50       # copies count once, rejected ones not at all
            + [(True, 300, 0.21, "en")] + [(True, 129, 0.3, "xx")] * 9 + [(True, 128, 0.5, None)])
    got = Q.word_limits(spark.createDataFrame(rows, f"kept boolean, n_words long, word_distance double, {Q.REFERENCE} string"))
    assert set(got) == {("en", 14), ("en", 16), ("xx", 14)}
    assert got["en", 14] == pytest.approx(0.2201 + Q.SPREADS * 0.1 * 0.2201, abs=1e-3)     # the spread's least value
    assert got["en", 16] == got["en", 14]                                                  # too few at this length
    assert 0.3 < got["xx", 14] < 0.35                                                      # too few of this language


def test_distance():
    p, q = np.array([1.0, 2, 0, 5]), np.array([0.0, 2, 3, 5])
    m = (p / 8 + q / 10) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x)
    assert Q.distance(p, q) == pytest.approx(((kl(p / 8) + kl(q / 10)) / 2) ** 0.5)
    assert Q.distance(p, p) == 0 and Q.distance(np.array([1.0, 0]), np.array([0.0, 1])) == pytest.approx(1)


def test_rows_kept(spark):
    docs = frame(spark, corpus() + AWKWARD, "kept", "_row_0", "a b")
    got = Q.keep_rows(docs)
    assert got.schema == docs.schema
    assert {r["doc_id"] for r in got.collect()} == set(range(120)) | {203, 204}
    assert Q.keep_rows(docs.limit(0)).count() == 0 and Q.judge(docs.limit(0)).count() == 0
