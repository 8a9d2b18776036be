import hashlib
import math
import random
import re
import time

from util import AWKWARD, frame

from tidepool.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in found.split(".")),
            "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def brute(text):
    """The plain patterns; long runs without the character a match needs are skipped (they take quadratic time)."""
    needs = {"email": "@", "ip": ".", "card": "", "phone": "+"}
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() if needs[k] in (text or "")
            for m in re.finditer(p, text or "") if valid(k, m.group())]


CASES = ["a@b.c_d@e.f", "x@y.z.@q.r", "a@b..c", "@a.b c@d.e-f.g, c@d", "ünï@x.yz — bob@corp.org!", "1.2.3.4.5.6.7.8 256.1.1.1 001.0002.3.255 1.2.3",
         "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111 12", "41111111111111114111111111111111", "+1 (555) 123-4567. +49 30 1234567- +1 2",
         "+1+12345678+", "+123456789012345 +1234567890123456", "a.b+c%d_e-f@g-h.i.j.", "漢字 me@x.io 🙂 +44 20 7946 0958", "4111  1111 1111 1111 1111",
         "a" * 3_000 + "@" + "b" * 3_000, "1" * 100_000, "1 " * 60_000, "5" * 3_000 + ".1.2.3", "+1 " + "(" * 80_000, "a." * 2_000 + "@x.y", "m@n.o " * 3_000]


def test_base_spans(spark):
    rows = [(100 + i, t) for i, t in enumerate(CASES)] + AWKWARD
    got = pii.report(frame(spark, rows, "spans", "digest", "s")).collect()
    want = []
    for i, t, *_ in rows:
        spans = brute(t)
        n = [sum(s.startswith(k) for s in spans) for k in PATTERNS]
        want.append((repr(i), *n, hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert sorted((repr(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == sorted(want)
    assert all(r["spans"].startswith(",".join(brute(dict((i, t) for i, t, *_ in rows)[r["doc_id"]]))) for r in got if r["doc_id"])
    assert pii.report(frame(spark, rows).limit(0)).count() == 0


def test_terms_that_give_an_entity_away(spark):
    told = [(i, f"Case {i}: the agent zyxwanda, at bob@corp.org, said so {'x' * i}", None, None) for i in range(4)]
    plain = [(10 + i, f"Case {10 + i}: the agent of zyxland {i} said nothing at all, so", None, None) for i in range(40)]
    copies = [(60 + i, "quizzical neighbour of ann@corp.org", None, None) for i in range(9)]     # one text: no evidence
    rows = told + plain + copies + [(90, "zyxwanda without any address", None, None)]
    got = {r["doc_id"]: r for r in pii.report(frame(spark, rows)).collect()}
    for i, t, *_ in told:
        at = t.index("zyxwanda")
        assert f"term:{at}:{at + 8}" in got[i]["spans"] and got[i]["n_term"] == 1     # agent and said are common
    assert all(got[i]["n_term"] == 0 for i in got if i >= 10)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, rows)).collect()}
    assert clean[0] == "Case 0: the agent zyx*, at [EMAIL], said so "                # many texts have a term in zyx
    assert clean[60] == "quizzical neighbour of [EMAIL]" and clean[90] == rows[-1][1]
    strict = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, told + [(70 + i, f"the agent {i} said so at Case", None, None) for i in range(40)])).collect()}
    assert strict[0] == "Case 0: the agent , at [EMAIL], said so "                   # no wider class: removed


def test_repeated_rows_and_rows_without_id_count_as_one_text(spark):
    told = [(i, f"Case {i}: the agent zyxwanda, at bob@corp.org, said so", None, None) for i in range(4)]
    plain = [(10 + i, f"Case {10 + i}: the agent of zyxland {i} said nothing", None, None) for i in range(40)]
    loose = [(None, f"Case {60 + i}: moonbase, at ann@corp.org, said so", None, None) for i in range(4)]
    elsewhere = [(None, f"Case {70 + i}: moonbase said nothing", None, None) for i in range(8)]
    rows = told * 5 + plain + loose * 3 + elsewhere + [(0, plain[7][1], None, None)]
    got = pii.report(frame(spark, rows)).collect()
    assert all(f"term:{t.index('zyxwanda')}:" in r["spans"] for i, t, *_ in told for r in got if r["doc_id"] == i and r["n_email"])
    # moonbase stands in 12 texts, 4 of them with ann: it gives nobody away
    assert all(r["n_term"] == 0 for r in got if r["doc_id"] is None)


def joint_terms(texts, disclosure=pii.DISCLOSURE):
    """The definition, entity by entity and term by term: for every text its disclosing terms."""
    texts = sorted(set(texts))
    holds, words = {}, [set(re.findall(r"[^\W_]+", t.lower())) for t in texts]
    for i, t in enumerate(texts):
        for s in brute(t):
            kind, start, end = s.split(":")
            found = t[int(start):int(end)]
            value = found.lower() if kind == "email" else found if kind == "ip" else re.sub("[^0-9]", "", found)
            form = value.split("@")[1] if kind == "email" else ".".join(value.split(".")[:2]) if kind == "ip" else value[:2]
            for name in ((kind, value), (kind, "class", form), (kind,)):
                holds.setdefault(name, set()).add(i)
            holds.setdefault(i, set()).add(((kind, value), (kind, "class", form), (kind,)))
    out = {}
    for i, t in enumerate(texts):
        for levels in holds.get(i, ()):
            group = next((g for g in levels[:2] if len(holds[g]) > 1), levels[2])
            rate = len(holds[group]) / len(texts)
            for w in words[i]:
                n, both = sum(w in x for x in words), sum(w in words[j] for j in holds[group])
                share = both / n if both > 2 else (both - 1 + 0.5 * rate) / (n - 0.5)
                if rate < 1 and math.log2(share / rate) >= -disclosure * math.log2(rate) - 1e-12:
                    out.setdefault(t, set()).add(w)
    return out


def test_terms_against_brute_force(spark):
    rng, rows = random.Random(5), []
    for i in range(300):
        words = [f"w{int(rng.paretovariate(0.5)) % 500}" for _ in range(rng.randrange(1, 40))]
        for _ in range(rng.choice((0, 0, 0, 1, 2))):
            who = rng.randrange(25)
            values = (f"p{who}@d{who % 6}.org", f"10.{who % 5}.3.{rng.randrange(250)}",
                      f"+{10 + who % 4} 555 {rng.randrange(10**5, 10**6)}",
                      "4111 1111 1111 1111", f"solo{i}@only{i}.org")
            kind = rng.randrange(5)
            value = values[kind]
            words.insert(rng.randrange(len(words) + 1), value)
            words.insert(rng.randrange(len(words) + 1), f"friend{who}k{kind}")
        rows.append((i, " ".join(words)))
    rows += [(400 + i, rows[7][1]) for i in range(20)] + rows[:15] + [(None, rows[9][1]), (None, "p1@d1.org friend1 unheard")]
    want = joint_terms([t for _, t in rows])
    got = pii.report(frame(spark, rows, "g", "term")).collect()
    assert len(got) == len(rows) and sum(r["n_term"] for r in got) > 50
    text = dict(rows[:-1])
    for r in got:
        if r["doc_id"] is None:
            continue
        t = text[r["doc_id"]]
        taken = [tuple(map(int, s.split(":")[1:])) for s in brute(t)]
        places = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W_]+", t) if m.group().lower() in want.get(t, ())
                  and not any(a < m.end() and b > m.start() for a, b in taken)]
        assert r["spans"] == ",".join(brute(t) + places)


def test_many_matches_in_one_text(spark):
    rows = [(1, "m@n.o joe " * 50_000), (2, "x joe m@n.o"), (3, "joe, m@n.o")] + [(10 + i, f"nothing {i}") for i in range(30)]
    began = time.time()
    got = {r["doc_id"]: r for r in pii.report(frame(spark, rows)).collect()}
    assert got[1]["n_email"] == 50_000 and got[1]["n_term"] == 50_000 and got[2]["n_term"] == 1 and got[10]["n_term"] == 0
    assert time.time() - began < 120


def test_terms_that_touch_a_base_span_stay_out(spark):
    rows = [(i, f"joe x4111111111111111y joe ün@x.yz q{i}") for i in range(4)] + [(10 + i, f"nothing {i}") for i in range(30)]
    got = {r["doc_id"]: r for r in pii.report(frame(spark, rows)).collect()}
    assert got[0]["spans"] == "email:28:34,card:5:21,term:0:3,term:23:26".replace("card:5:21", f"card:{rows[0][1].index('4')}:{rows[0][1].index('4') + 16}").replace(
        "email:28:34", f"email:{rows[0][1].index('n@')}:{rows[0][1].index(' q')}")


def test_no_python_in_the_plan(spark):
    plan = pii.report(frame(spark, [(1, "a@b.c")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
