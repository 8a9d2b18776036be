"""Personal data: pattern spans, and information-theoretic sanitisation of the
terms that give them away.  DataFrame operations only.

Base spans come from four patterns (e-mail, IP, card, phone).  A text is split by
a pattern; running sums of the lengths of pieces and matches, by doubling, are the
places.  The patterns are possessive and start at the edge of a run, so that long
runs cost linear time and no stack; they find the same matches as the plain forms.

Every value of a base span is a protected entity.  Masking it is not enough if a
term of the text gives it away, so the corpus is asked how strongly a term reveals
it (Sanchez and Batet, C-sanitized).  With document frequencies over different texts,

    IC(e) = -log2 p(e)      PMI(e; t) = log2 p(e | t) / p(e),

and a term (a run of letters or digits, of any length, anywhere in a text of the
entity) discloses it if PMI(e; t) >= ``DISCLOSURE`` * IC(e): at 1, the term never
stands without the entity.  p(e | t) is the share of the term's texts that hold the
entity.  One or two joint texts are thin evidence: there the share is taken over
the other texts, as the text at hand would speak for itself, and ``PRIOR`` texts at
the rate p(e) are added.  So a term that stands in one text reveals nothing.

A value of one text says nothing by itself and is scored as its class (mail domain,
network, first digits of a card or phone number), or, if that stands in one text
too, as its kind.  Entities and classes that stand in exactly the same texts have
the same scores and are scored once, by a digest of the set of their texts.

Such terms get a span of kind ``term`` wherever they stand in the entity's texts
outside of base spans.  Sanitising generalises a term to its first letters if so
many texts have a term with these letters that the disclosure falls below the
threshold (bounded from below by the most frequent such term); else it goes.

Exact copies are no evidence: a text counts once.  Rows that share doc_id repeat
the text; rows without doc_id are treated like others, by the digest of their text.
Very long texts are read whole, in time near to linear in matches and characters;
a term at the threshold discloses.  A null text counts as empty; texts without
matches have no spans; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import staged, text_or_empty

DISCLOSURE = 0.9
THIN = 2      # up to so many joint texts, the share is smoothed
PRIOR = 0.5
LETTERS = 3
KINDS = ("email", "ip", "card", "phone")

#: Fixed by the contract, in possessive form.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts that cannot hold a match are not split.
_MAY_HOLD = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.contains("+"),
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_TERM = r"[\p{L}\p{N}]+"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def share(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, d * 2 - F.when(d >= 5, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), share), F.lit(0), lambda a, x: a + x) % 10 == 0


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda m: F.length(_digits(m)).between(16, 19) & _luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}
_VALUE = {"email": F.lower, "ip": lambda m: m, "card": _digits, "phone": _digits}


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, combine) -> Column:
    """Sums or maxima of whole numbers from 0 up to and with each element: each step
    combines with the result from twice as far back."""
    def step(done: Column, far: Column) -> Column:
        back = F.concat(F.array_repeat(F.lit(0), far), F.slice(done, 1, F.size(done) - far))
        return F.zip_with(done, back, combine)

    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(30)]), lambda far: far < F.size(values))
    return F.aggregate(steps, values, step)


def matches(text: Column, pattern: str, valid, wrap) -> Column:
    """Array of ``wrap(match, start, end)`` for the valid matches of a pattern, in order.

    Splitting and extracting find the same leftmost matches without overlap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), F.length)

    def placed(v: Column) -> Column:
        # the piece after the last match has no match beside it
        steps = F.zip_with(v["m"], F.slice(v["p"], 1, F.size(v["m"])), lambda m, p: F.length(m) + p)
        ends = _once(steps, lambda lengths: _running(lengths, lambda x, y: x + y))
        return F.zip_with(v["m"], ends, lambda m, end: F.struct(m.alias("m"), end.alias("end")))

    kept = F.filter(_once(F.struct(found.alias("m"), pieces.alias("p")), placed), lambda x: valid(x["m"]))
    return F.transform(kept, lambda x: wrap(x["m"], x["end"] - F.length(x["m"]), x["end"]))


def _span(kind: str):
    def wrap(match: Column, start: Column, end: Column) -> Column:
        value = F.concat(F.lit(kind + ":"), _VALUE[kind](match))
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), value.alias("entity"))
    return wrap


def base_spans(text: Column, kind: str) -> Column:
    """``array<struct<kind, start, end, entity>>`` of one kind, in order of start."""
    none = F.filter(F.array(_span(kind)(F.lit(""), F.lit(0), F.lit(0))), lambda _: F.lit(False))
    return F.when(_MAY_HOLD[kind](text), matches(text, PATTERNS[kind], _VALID[kind], _span(kind))).otherwise(none)


def _class(entity: Column) -> Column:
    """What is known of a value by its form: mail domain, network, first digits."""
    return (F.when(entity.startswith("email:"), F.concat(F.lit("email@"), F.substring_index(entity, "@", -1)))
            .when(entity.startswith("ip:"), F.substring_index(entity, ".", 2))
            .otherwise(F.regexp_extract(entity, "^[a-z]+:[0-9]{2}", 0)))


def _groups(mention: DataFrame) -> DataFrame:
    """``digest, g, g_texts, here``: the entities, classes and kinds that a text holds,
    by the digest of the set of their texts; ``here`` if some value of the text is scored so."""
    names = {"entity": F.col("entity"), "class": F.concat(F.lit("class "), _class(F.col("entity"))),
             "kind": F.concat(F.lit("kind "), F.substring_index("entity", ":", 1))}
    named = staged(mention.select("digest", *[c.alias(k) for k, c in names.items()]), "mentions")
    each = named.select("digest", F.explode(F.array(*names)).alias("name")).distinct()
    sets = each.groupBy("name").agg(F.count("*").alias("g_texts"), F.bit_xor(F.xxhash64("digest")).alias("x"),
                                    F.bit_xor(F.xxhash64(F.lit("set"), "digest")).alias("y"))
    sets = staged(sets.select("name", "g_texts", F.md5(F.concat_ws(",", "g_texts", "x", "y")).alias("g")), "sets")

    def texts_of(name: str) -> DataFrame:
        return sets.select(F.col("name").alias(name), F.col("g_texts").alias(f"{name}_texts"))

    level = (F.when(F.col("entity_texts") > 1, F.col("entity")).when(F.col("class_texts") > 1, F.col("class")).otherwise(F.col("kind")))
    scored = (named.join(texts_of("entity"), "entity").join(texts_of("class"), "class")
              .select("digest", level.alias("name"), F.lit(True).alias("here")))
    held = each.withColumn("here", F.lit(False)).unionByName(scored)
    held = staged(held.groupBy("digest", "name").agg(F.max("here").alias("here")), "held")
    return staged(held.join(sets, "name").groupBy("digest", "g").agg(F.max("g_texts").alias("g_texts"), F.max("here").alias("here")), "groups")


def _apart(terms: Column, base: Column) -> Column:
    """The terms that overlap no base span.  In order of start and, for terms, of the last
    place, a term is clear if all base spans before it end before it."""
    none = F.lit(None).cast("struct<kind:string,start:int,end:int,action:string>")
    events = F.array_sort(F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("at"), F.lit(0).alias("order"), s["end"].alias("end"), none.alias("term"))),
        F.transform(terms, lambda t: F.struct((t["end"] - 1).alias("at"), F.lit(1).alias("order"), F.lit(0).alias("end"), t.alias("term")))))

    def clear(e: Column) -> Column:
        reach = _once(F.transform(e, lambda x: x["end"]), lambda ends: _running(ends, lambda x, y: F.greatest(x, y)))
        both = F.zip_with(e, reach, lambda x, r: F.struct(x["term"].alias("term"), r.alias("reach")))
        clear_terms = F.filter(both, lambda b: b["term"].isNotNull() & (b["term"]["start"] >= b["reach"]))
        return F.transform(clear_terms, lambda b: b["term"])

    return F.sort_array(_once(events, clear))


def disclosing(n_texts: Column, g_texts: Column, t_texts: Column, both: Column, disclosure: float = DISCLOSURE) -> Column:
    """Whether a term of ``t_texts`` texts, ``both`` of them with the entity, gives it away."""
    rate = g_texts / n_texts
    share = (F.when(both > THIN, both / t_texts)
             .otherwise((both - 1 + PRIOR * rate) / (t_texts - 1 + PRIOR)))
    return (rate < 1) & (F.log2(share / rate) >= -disclosure * F.log2(rate))


def find(docs: DataFrame, text: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """One row per document: ``doc_id, digest`` and ``spans``, an array of
    ``kind, start, end, action`` by kind and start; ``action`` is ``mask`` for base
    spans, ``generalise`` or ``remove`` for terms."""
    body = text_or_empty(text)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"))
    rows = docs.select("doc_id", F.md5("text").alias("digest"), F.concat(*[base_spans(F.col("text"), k) for k in KINDS]).alias("spans"), "text")
    rows = staged(rows.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))), "spans")

    mention = rows.filter(F.size("spans") > 0).select("digest", F.explode("spans.entity").alias("entity")).distinct()
    group = _groups(staged(mention, "values"))
    most_texts = group.agg(F.coalesce(F.max("g_texts"), F.lit(0))).first()[0]

    # Texts by term, over one document of each text (with or without doc_id); where its
    # row is repeated, the terms are counted once by the text's digest.
    first = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n")).groupBy("digest").agg(F.min(F.struct("doc_id", "n")).alias("f"))
    first = staged(first.select(F.col("digest").alias("f_digest"), F.col("f.doc_id").alias("f_doc_id"), F.when(F.col("f.n") > 1, F.col("digest")).alias("again")), "first")
    n = first.count()
    n_texts = F.lit(n).cast("double")
    one_each = (docs.withColumn("digest", F.md5("text"))
                .join(first.hint("merge"), F.col("doc_id").eqNullSafe(F.col("f_doc_id")) & (F.col("digest") == F.col("f_digest"))))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_TERM), F.lit(0)))
    texts = (one_each.select("again", F.explode(words).alias("t_term"))
             .groupBy("t_term", "again").agg(F.count("*").alias("n"))
             .groupBy("t_term").agg(F.sum(F.when(F.col("again").isNull(), F.col("n")).otherwise(F.lit(1))).alias("t_texts")))
    # A term of one text reveals nothing; one of more texts than this falls short of any entity's threshold.
    def most(g_texts: Column) -> Column:
        return F.pow(g_texts, F.lit(disclosure)) * F.pow(n_texts, F.lit(1 - disclosure)) + 1
    texts = staged(texts.filter(F.col("t_texts") > 1).withColumn("stem", F.substring("t_term", 1, LETTERS)), "texts")

    held = staged(rows.filter(F.size("spans") > 0).select("digest", "text").dropDuplicates(["digest"]), "texts_with_values")
    words = held.select("digest", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_TERM), F.lit(0)))).alias("term"))
    near = texts.filter(F.col("t_texts") <= most(F.lit(most_texts)))
    words = staged(words.join(near, F.col("term") == F.col("t_term")).select("digest", "term", "t_texts", "stem"), "words")
    beside = words.join(group, "digest").filter(F.col("t_texts") <= most(F.col("g_texts")))
    beside = staged(beside.select("digest", "g", "g_texts", "here", "term", "t_texts", "stem"), "beside")
    pair = beside.groupBy("g", "g_texts", "term", "t_texts", "stem").agg(F.count("*").alias("both"), F.max("here").alias("here"))
    pair = staged(pair.filter("here").filter(disclosing(n_texts, F.col("g_texts"), F.col("t_texts"), F.col("both"), disclosure)), "pairs")

    stems = staged(pair.select("stem").distinct(), "stems")
    stem_texts = texts.join(stems, "stem", "left_semi").groupBy(F.col("stem").alias("m_stem")).agg(F.max("t_texts").alias("stem_texts"))
    wide = F.log2(n_texts * F.least("g_texts", "stem_texts") / (F.col("g_texts") * F.col("stem_texts"))) >= disclosure * F.log2(n_texts / F.col("g_texts"))
    reveals = staged(pair.join(staged(stem_texts, "stem_texts"), F.col("stem") == F.col("m_stem"))
                     .select("g", "term", F.when(wide, "remove").otherwise("generalise").alias("action")), "reveals")
    told = (beside.filter("here").select("digest", "g", "term").join(reveals, ["g", "term"])
            .groupBy("digest", "term").agg(F.max("action").alias("action")))  # remove over generalise
    told = staged(told, "told")

    def word(match: Column, start: Column, end: Column) -> Column:
        return F.struct(F.lower(match).alias("term"), start.alias("start"), end.alias("end"))

    place = (held.join(told.select("digest").distinct(), "digest", "left_semi")
             .select("digest", F.explode(matches(F.col("text"), _TERM, lambda m: F.lit(True), word)).alias("w")).select("digest", "w.*"))
    hit = place.join(told, ["digest", "term"]).select("digest", "start", "end", "action")
    by_text = hit.groupBy(F.col("digest").alias("h_digest")).agg(F.sort_array(F.collect_list(F.struct(
        F.lit("term").alias("kind"), "start", "end", "action"))).alias("terms"))
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit("mask").alias("action")))
    whole = rows.select("doc_id", "digest", base.alias("base")).join(staged(by_text, "terms"), F.col("digest") == F.col("h_digest"), "left")
    apart = F.concat("base", _apart(F.col("terms"), F.col("base")))
    return whole.select("doc_id", "digest", F.when(F.col("terms").isNull(), F.col("base")).otherwise(apart).alias("spans"))


def report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term``."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "term")
    return find(docs, **options).select("doc_id", *[of(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"),
                                        joined(F.col("spans")).alias("spans"), of("term"))


def sanitise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``doc_id, text``: base spans masked by kind, terms generalised or removed.
    Where spans overlap, the one that starts first (then the longest) decides."""
    found = find(docs, text, **options).filter(F.size("spans") > 0).select(F.col("digest").alias("f_digest"), "spans").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("digest", F.md5(text_or_empty("text")))
    in_order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], (-s["end"]).alias("e"), s["kind"], s["action"])))

    def step(acc: Column, s: Column) -> Column:
        start, end = s["start"], -s["e"]
        term = F.substring(F.col("text"), start + 1, end - start)
        new = (F.when(s["action"] == "mask", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
               .when(s["action"] == "generalise", F.concat(F.substring(term, 1, LETTERS), F.lit("*"))).otherwise(""))
        done = F.struct(end.alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, start - acc["at"]), new).alias("out"))
        return F.when(start >= acc["at"], done).otherwise(acc)

    whole = F.aggregate(in_order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return (rows.join(staged(found, "found"), F.col("digest") == F.col("f_digest"), "left")
            .select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(whole).alias("text")))
