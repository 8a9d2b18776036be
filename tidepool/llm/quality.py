"""Quality rules: base counts, and the distance of a document from its language.

For every language (column ``lang``) two reference histograms are gathered from
the whole corpus, in which documents weigh alike: character classes, and common
words, i.e. the words with a letter whose mean share of a document's words is at
least ``COMMON``, with one bin for all others.  A document is rejected if the Jensen-Shannon distance (base 2, 0 to 1) of
its own histograms is above a limit, provided that it is long enough for the
histogram to mean something.  A document whose language is null or has too few
documents for a reference is compared with the nearest reference.

The limit of the word distance comes from the documents themselves, as short ones
stand farther off by chance: for every reference and length (half octaves of words),
over the different distances of the documents that pass all other rules, the median
plus ``SPREADS`` normal deviations.  The deviation is measured below the median, where
poor documents do not reach, and is at least ``LEAST_SPREAD`` of the median, so that a
group of near copies sets no narrow limit.  With fewer than ``LIMIT_DOCS`` distances
those of all languages at this length decide, then the language's next shorter length;
``WORD_LIMIT`` holds above all.

Common words are exact, without a shuffle of the vocabulary: a task reports, per
chunk of documents, those with at least half the share; a word that is common in the
whole must then make up for the chunks that do not report it, which leaves at most
``2 / COMMON`` words per language.  A second pass over the texts, the last one, counts those in
every document, for the references and for the document itself, and takes the base counts; the
distances come from these counts.

Defined results: a null text has no words and fails the base rule, like an empty
one; very long texts are judged whole; a word that is exactly at a share counts as common, and a
document exactly at a limit stays; the reference nearest by the sum of both distances is taken, at a tie the
first by name; repeated rows are judged alike; with no reference at all the base rule
decides; an empty table gives an empty result; further columns of the input are
ignored, or returned untouched by ``keep_rows``.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tidepool.llm.common import staged

COMMON = 0.002               # mean share of a document's words that makes a word common
REFERENCE_DOCS = 10          # documents with words that a language needs for a reference
SCALE = 1_000_000            # a document's weight, in whole numbers so that sums do not depend on their order
CHUNK_WORDS = 400_000
KNOWN_WORDS = 200_000        # words that a task remembers
STEP = 500                   # documents that a task looks at together
CLASS_LIMIT, CLASS_MIN_CHARS = 0.30, 200
WORD_LIMIT, WORD_MIN_WORDS = 0.52, 80
SPREADS, LEAST_SPREAD, LIMIT_DOCS = 4, 0.1, 30
QUARTILE = 0.6745            # of the normal distribution, in deviations
STEPS = 10_000               # steps of the distance in which limits are counted
MIN_WORDS, REPEAT_PERCENT = 50, 50
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = b".,;:!?\"'()-"
CLASSES = 7

_CLASS = np.full(256, 5, np.uint8)                       # other ASCII
_CLASS[[ord(c) for c in BLANKS]] = 0
_CLASS[ord("a"):ord("z") + 1] = 1
_CLASS[ord("A"):ord("Z") + 1] = 2
_CLASS[ord("0"):ord("9") + 1] = 3
_CLASS[list(PUNCTUATION)] = 4
_CLASS[0xC0:] = 6                                        # first byte of any other character
_CLASS[0x80:0xC0] = CLASSES                              # its other bytes do not count


def class_counts(raw: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=CLASSES + 1)[:CLASSES]


def common_form(word: bytes) -> bytes:
    return word.strip(PUNCTUATION)


def _has_letter(word: bytes) -> bool:
    return any(c >= 0x80 or 97 <= c <= 122 for c in word)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms (counts or shares)."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def part(a: np.ndarray) -> float:
        at = a > 0
        return float((a[at] * np.log2(a[at] / m[at])).sum())

    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def repeated_words(words: list[bytes], distinct: Iterable[bytes] | None = None) -> int:
    """Words that lie in 3-word windows which the text holds at least twice."""
    if len(words) < 4:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words) if distinct is None else distinct)}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    kinds = len(number)
    pairs = ids[:-1] * kinds + ids[1:]
    if kinds >= 1 << 20:                                 # three numbers do not fit one
        pairs, kinds = np.unique(pairs, return_inverse=True)[1], kinds
    window = pairs[:-1] * kinds + ids[2:]
    ordered = np.sort(window)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(window, twice))
    again[at] += 1
    again[at + 3] -= 1
    return int((np.cumsum(again) > 0).sum())


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(BLANKS):
            seen.add(line)
    return again


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, STEP) for b in batches for at in range(0, b.num_rows, STEP))


class _Numbers(dict):
    """Numbers of words, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Tally:
    """Of the documents of a language: their number, weighted word shares, class shares."""

    def __init__(self):
        self.docs, self.classes = 0, np.zeros(CLASSES, np.int64)
        self.numbers, self.seen, self.shares = _Numbers(), [], []

    def add(self, raw: bytes, tokens: list[bytes]) -> None:
        self.docs += 1
        counts = Counter(tokens)
        self.seen.append(np.fromiter(map(self.numbers.__getitem__, counts), np.int64, len(counts)))
        self.shares.append(np.fromiter(counts.values(), np.int64, len(counts)) * SCALE // len(tokens))
        self.classes += class_counts(raw) * SCALE // len(raw)

    def forms(self) -> Counter:
        out: Counter = Counter()
        # whole numbers below 2 ** 53: exact in doubles
        total = np.bincount(np.concatenate(self.seen), np.concatenate(self.shares)).astype(np.int64).tolist()
        for word, n in zip(self.numbers, total):
            out[common_form(word)] += n
        return out


def _report(share: float):
    """Per chunk of words and language: weight and classes of its documents, and the words that may be common."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64()), ("chunk", pa.int64()), ("classes", pa.list_(pa.int64()))])

    def rows(tallies: dict[str, _Tally]) -> pa.RecordBatch:
        out = []
        for lang, tally in tallies.items():
            total = tally.docs * SCALE
            out.append((lang, None, 0, total, tally.classes.tolist()))
            out += [(lang, w, n, total, None) for w, n in tally.forms().items() if n >= share / 2 * total and _has_letter(w)]
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies, n = defaultdict(_Tally), 0
        for batch in _steps(batches):
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                tokens = raw.lower().split()
                if tokens:
                    tallies[lang].add(raw, tokens)
                n += len(tokens)
                if n >= CHUNK_WORDS:
                    yield rows(tallies)
                    tallies, n = defaultdict(_Tally), 0
        yield rows(tallies)
    return run


class _Known(dict):
    """Number of the lower-case word behind each word, if its common form is wanted, else -1;
    ``form_of`` gives the form's number by the lower-case word's."""

    def __init__(self, forms: dict[bytes, int]):
        super().__init__()
        self.forms, self.variants, self.form_of = forms, {}, []

    def __missing__(self, word: bytes) -> int:
        low = word.lower()
        form = self.forms.get(common_form(low), -1)
        if form < 0:
            variant = -1
        elif (variant := self.variants.get(low, -1)) < 0:
            variant = self.variants[low] = len(self.form_of)
            self.form_of.append(form)
        if len(self) < KNOWN_WORDS:
            self[word] = variant
        return variant


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
_COUNTS = [("_lang", StringType()), ("_n_chars", LongType()), ("_classes", ArrayType(LongType())), ("_forms", ArrayType(IntegerType())),
           ("_form_counts", ArrayType(LongType())), ("_t_lang", StringType()), ("_t_form", IntegerType()), ("_t_n", LongType())]


def _measure(forms: dict[bytes, int], wanted: dict[str, set[int]], text_at: int, carried: int, passing_only: bool):
    """Rows of two kinds.  Documents: base counts, classes, and how often each wanted form stands in them.  And per
    task and language the weighted shares of its wanted forms (``_t_*``).  Columns: the language, the text
    at ``text_at``, and from ``carried`` on those that are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(forms)
        tally = {lang: np.zeros(len(forms), np.int64) for lang in wanted}
        base_types = [pa.int64()] * 5 + [pa.bool_()]
        count_types = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string(), pa.int32(), pa.int64()]
        names, fields = [], []
        for batch in _steps(batches):
            if len(known.form_of) > KNOWN_WORDS:
                known = _Known(forms)
            names, fields = batch.schema.names[carried:], [f.type for f in batch.schema][carried:]
            out, stays = [], []
            for row, (lang, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(text_at).to_pylist())):
                text = text or ""
                raw = text.encode()
                words = raw.split()
                counts = Counter(words)
                n = np.fromiter(counts.values(), np.int64, len(counts))
                variant = np.fromiter(map(known.__getitem__, counts), np.int64, len(counts))
                common = variant >= 0
                low, at = np.unique(variant[common], return_inverse=True)
                times = np.bincount(at, n[common], minlength=len(low)).astype(np.int64)
                form = np.array(known.form_of, np.int64)[low] if len(low) else low
                if lang in tally and words:
                    np.add.at(tally[lang], form, times * SCALE // len(words))
                again = repeated_words(words, counts)
                failed = len(words) < MIN_WORDS or 100 * again > REPEAT_PERCENT * len(words)
                if failed and passing_only:
                    continue
                one, place = np.unique(form, return_inverse=True)
                stays.append(row)
                out.append((len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), repeated_lines(text), again, failed,
                            lang, len(text), class_counts(raw), one, np.bincount(place, times, minlength=len(one)).astype(np.int64), None, None, None))
            columns = list(zip(*out)) if out else [()] * (len(BASE) + len(_COUNTS))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, base_types + count_types)),
                                              *(batch.column(i + carried).take(pa.array(stays, pa.int64())) for i in range(len(names)))],
                                             [*BASE, *(c for c, _ in _COUNTS), *names])
        for lang, shares in tally.items():
            at = np.flatnonzero(shares)
            if len(at) and fields:
                yield pa.RecordBatch.from_arrays(
                    [*(pa.nulls(len(at), t) for t in base_types + count_types[:-3]), pa.array([lang] * len(at), pa.string()),
                     pa.array(at, pa.int32()), pa.array(shares[at]), *(pa.nulls(len(at), t) for t in fields)],
                    [*BASE, *(c for c, _ in _COUNTS), *names])
    return run


Reference = tuple[np.ndarray, dict[bytes, int], np.ndarray]


def _measured(rows: DataFrame, words: dict[str, Iterable[bytes]], text_at: int = 1, carried: int = 2, passing_only: bool = False,
              tallied: bool = True) -> tuple[DataFrame, list[bytes]]:
    """What ``_measure`` finds, stored, and the forms behind the numbers."""
    forms = sorted({w for own in words.values() for w in own})
    number = {w: i for i, w in enumerate(forms)}
    wanted = {lang: {number[w] for w in own} for lang, own in words.items()} if tallied else {}
    base = [StructField(n, t) for n, t in zip(BASE, [LongType()] * 5 + [BooleanType()])]
    schema = StructType([*base, *(StructField(n, t) for n, t in _COUNTS), *(StructField(f.name, f.dataType) for f in rows.schema.fields[carried:])])
    return staged(rows.mapInArrow(_measure(number, wanted, text_at, carried, passing_only), schema), "measured"), forms


def _candidates(rows: DataFrame, common: float, min_docs: int) -> tuple[DataFrame, dict[str, list[bytes]]]:
    """``lang, total, c0..`` of the languages with enough documents, and the words of each that may be common."""
    rows = rows.filter("lang is not null and text is not null")
    seen = staged(rows.mapInArrow(_report(common), "lang string, word binary, n long, chunk long, classes array<long>"), "report")
    shape = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(CLASSES)]
    langs = seen.filter("word is null").groupBy("lang").agg(F.sum("chunk").alias("total"), *shape).filter(F.col("total") >= min_docs * SCALE)
    langs = staged(langs, "langs")
    unseen = (F.col("total") - F.col("chunks")) * (common / 2)
    likely = (seen.filter("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("chunk").alias("chunks"))
              .join(langs.select("lang", "total"), "lang").filter(F.col("n") + unseen >= F.col("total") * common))
    words: dict[str, list[bytes]] = {r["lang"]: [] for r in langs.select("lang").collect()}
    for r in likely.select("lang", "word").collect():
        words[r["lang"]].append(bytes(r["word"]))
    return langs, words


def _gathered(langs: DataFrame, words: dict[str, list[bytes]], measured: DataFrame, forms: list[bytes], common: float) -> dict[str, Reference]:
    counted: dict[str, list] = defaultdict(list)
    shares = measured.filter("_t_lang is not null").groupBy("_t_lang", "_t_form").agg(F.sum("_t_n").alias("n"))
    own = {lang: set(w) for lang, w in words.items()}
    for r in shares.collect():
        if forms[r["_t_form"]] in own[r["_t_lang"]]:
            counted[r["_t_lang"]].append((r["n"], forms[r["_t_form"]]))
    out = {}
    for r in langs.collect():
        found = sorted((x for x in counted[r["lang"]] if x[0] >= common * r["total"]), reverse=True)
        counts = [n for n, _ in found]
        out[r["lang"]] = (np.array([r[f"c{i}"] for i in range(CLASSES)], float), {w: i for i, (_, w) in enumerate(found)},
                          np.array([*counts, r["total"] - sum(counts)], float))
    return out


def references(docs: DataFrame, common: float = COMMON, min_docs: int = REFERENCE_DOCS, text: str = "text") -> dict[str, Reference]:
    """By language: class histogram, bins of the common words, histogram of the words
    (last bin: all others).  At most ``1 / common`` words per language."""
    rows = docs.select("lang", F.col(text).alias("text"))
    langs, words = _candidates(rows, common, min_docs)
    measured, forms = _measured(rows.withColumn("_row", F.lit(0)), words)
    return _gathered(langs, words, measured, forms, common)


def distances(own: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row, a histogram, from the reference."""
    p, q = own / own.sum(axis=1, keepdims=True), reference / reference.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)
    return np.sqrt(np.maximum(0.0, (left + right) / 2))


_FOUND = "class_distance double, word_distance double, _reference string"


def _distances(refs: dict[str, Reference], forms: list[bytes]):
    """Distances from the language's reference, or from the nearest."""
    names = sorted(refs)
    bins = {name: np.array([refs[name][1].get(w, len(refs[name][1])) for w in forms], np.int64) for name in names}

    def part(rows: np.ndarray, name: str, n_words: np.ndarray, classes: np.ndarray, at: np.ndarray, form: np.ndarray, counts: np.ndarray):
        shape, own_bins, histogram = refs[name]
        other = len(own_bins)
        own = np.zeros((len(rows), other + 1))
        for i, r in enumerate(rows):
            np.add.at(own[i], bins[name][form[at[r]:at[r + 1]]], counts[at[r]:at[r + 1]])
        own[:, other] += n_words[rows] - own.sum(axis=1)
        return distances(classes[rows], shape), distances(own, histogram)

    def run(lang: pa.Array, n_words: pa.Array, classes: pa.Array, forms: pa.Array, counts: pa.Array) -> pa.Array:
        size = len(lang)
        lang, n_words = lang.to_pylist(), n_words.to_numpy(zero_copy_only=False)
        classes = classes.flatten().to_numpy(zero_copy_only=False).reshape(size, CLASSES).astype(float)
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(forms).to_numpy(zero_copy_only=False))])
        form, counts = forms.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False)
        by_class, by_word, near = np.zeros(size), np.zeros(size), np.full(size, None, object)
        groups = defaultdict(list)
        for row in np.flatnonzero(n_words > 0):
            groups[lang[row] if lang[row] in refs else None].append(row)
        for own, rows in groups.items():
            for first in range(0, len(rows), STEP):
                some = np.array(rows[first:first + STEP])
                best = np.full(len(some), np.inf)
                for name in names if own is None else [own]:
                    a, b = part(some, name, n_words, classes, at, form, counts)
                    better = a + b < best
                    best[better] = (a + b)[better]
                    by_class[some[better]], by_word[some[better]], near[some[better]] = a[better], b[better], name
        none = np.array([x is None for x in near], bool)
        return pa.StructArray.from_arrays([pa.array(by_class, mask=none), pa.array(by_word, mask=none), pa.array(near, pa.string())],
                                          ["class_distance", "word_distance", "_reference"])

    return F.arrow_udf(run, _FOUND)


NAMES = [*BASE, "kept", "class_distance", "word_distance"]
REFERENCE = "_reference"     # the language whose reference was the nearest


def _judged(measured: DataFrame, refs: dict[str, Reference], forms: list[bytes], class_limit: float, word_limit: float) -> DataFrame:
    """The documents with distances; ``kept`` is before the limits of the languages."""
    docs = measured.filter("_t_lang is null")
    found = docs.withColumn("_found", _distances(refs, forms)("_lang", "n_words", "_classes", "_forms", "_form_counts"))
    found = found.select("*", "_found.*").drop("_found", "_classes", "_forms", "_form_counts", "_t_lang", "_t_form", "_t_n")
    far = (((F.col("_n_chars") >= CLASS_MIN_CHARS) & (F.col("class_distance") > class_limit))
           | ((F.col("n_words") >= WORD_MIN_WORDS) & (F.col("word_distance") > word_limit)))
    return found.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def _length_step() -> Column:
    return F.floor(2 * F.log2("n_words")).cast("int")


def word_limits(judged: DataFrame) -> dict[tuple[str, int], float]:
    """Limit of the word distance by reference and length, from the documents kept so far."""
    rows = judged.filter(F.col("kept") & (F.col("n_words") >= WORD_MIN_WORDS) & F.col(REFERENCE).isNotNull())
    # copies have equal distances and count once
    once = rows.select(REFERENCE, _length_step().alias("length"), F.round(F.col("word_distance") * 1e12).alias("d")).distinct()
    steps = staged(once.groupBy(REFERENCE, "length", F.floor(F.col("d") / (1e12 / STEPS)).alias("step")).agg(F.count("*").alias("n")), "steps")
    quartiles = [F.sum("n").alias("n"), F.percentile("step", F.array(F.lit(0.25), F.lit(0.5)), F.col("n")).alias("q")]
    limits = {}
    for by in ([REFERENCE, "length"], ["length"]):
        for r in steps.groupBy(*by).agg(*quartiles).collect():
            low, middle = ((x + 1) / STEPS for x in r["q"])
            limit = middle + SPREADS * max((middle - low) / QUARTILE, LEAST_SPREAD * middle)
            limits[r[REFERENCE] if len(by) > 1 else None, r["length"]] = limit if r["n"] >= LIMIT_DOCS else None
    out = {}
    for lang in {name for name, _ in limits if name is not None}:
        last = None
        for length in sorted(n for name, n in limits if name == lang):
            last = limits[lang, length] or limits[None, length] or last
            if last is not None:
                out[lang, length] = last
    return out


def _within_limits(judged: DataFrame) -> DataFrame:
    """``judged`` (read twice) with ``kept`` after the limits of the languages."""
    limits = [(*key, limit) for key, limit in word_limits(judged).items()]
    table = judged.sparkSession.createDataFrame(limits, "_l_reference string, _l_length int, _l_limit double")
    # at most two rows per reference and doubling of the length
    joined = judged.join(F.broadcast(table), (F.col(REFERENCE) == F.col("_l_reference")) & (_length_step() == F.col("_l_length")), "left")
    far = (F.col("n_words") >= WORD_MIN_WORDS) & (F.col("word_distance") > F.col("_l_limit"))
    return joined.withColumn("kept", F.col("kept") & ~F.coalesce(far, F.lit(False))).drop(*table.columns)


def _all_steps(rows: DataFrame, refs: dict[str, Reference] | None, class_limit: float, word_limit: float, text_at: int = 1, carried: int = 2,
               passing_only: bool = False) -> DataFrame:
    """Judged rows; for the columns see ``_measure``."""
    if refs is None:
        langs, words = _candidates(rows.select(F.col(rows.columns[0]).alias("lang"), F.col(rows.columns[text_at]).alias("text")), COMMON, REFERENCE_DOCS)
        measured, forms = _measured(rows, words, text_at, carried, passing_only)
        refs = _gathered(langs, words, measured, forms, COMMON)
    else:
        measured, forms = _measured(rows, {lang: bins for lang, (_, bins, _) in refs.items()}, text_at, carried, passing_only, tallied=False)
    return _judged(measured, refs, forms, class_limit, word_limit)


def judge(docs: DataFrame, refs: dict | None = None, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT,
          text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, the base counts, ``base_failed, kept`` and the two distances."""
    rows = docs.select("lang", F.col(text).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    found = staged(_all_steps(rows, refs, class_limit, word_limit), "judged")
    return _within_limits(found).select("doc_id", *NAMES)


def keep_rows(docs: DataFrame, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT, text: str = "text") -> DataFrame:
    """The documents, all columns, that the rules keep: judged where they are, without a shuffle of texts."""
    names = [f"_row_{i}" for i in range(len(docs.columns))]
    rows = docs.select(F.col("lang").alias("_of"), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    kept = _all_steps(rows, None, class_limit, word_limit, 1 + docs.columns.index(text), 1, True).filter("kept")
    return _within_limits(kept).filter("kept").select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
