import random
from collections import defaultdict

import duckdb
from compare import rows as canon

from tidepool.llm import chat
from tidepool.llm.oracle import ORACLE

SCHEMA = "conv_id long, turn long, role string, text string, pos long, part string"


def log():
    rng = random.Random(8)
    rows, conv = [], 0
    for _ in range(15):
        full = [(rng.choice(["user", "assistant", None]), rng.choice(["Hi", "", None, f"text {rng.randrange(9)}", "ünï 漢"])) for _ in range(rng.randrange(1, 9))]
        for n in sorted({rng.randrange(1, len(full) + 1) for _ in range(4)} | {len(full)}):
            for _ in range(rng.randrange(1, 3)):          # the same snapshot, logged again
                rows += [(conv, t * 10, r, x) for t, (r, x) in enumerate(full[:n])]
                conv += 1
    rows += [(900, t, "user", f"long {t}") for t in range(2_500)] + [(901, t, "user", f"long {t}") for t in range(1_700)]
    rows += [(902, None, "user", f"loose {t}") for t in range(30)] + [(903, 1, "user", "same"), (903, 1, "user", "same"), (904, 1, "user", "same")]
    rows += [(905, 2, "tool", ""), (906, 2, "tool", None), (None, 1, "user", "nobody's"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def brute(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t, r, x))
    order = lambda v: (v[0] is not None, v[0] or 0)  # noqa: E731  ties are equal rows here, or compared as sets
    seqs = {c: sorted(v, key=order) for c, v in conv.items()}
    plain = {c: tuple((r, x) for _, r, x in v) for c, v in seqs.items()}
    return {c for c, s in plain.items() if not any(
        (len(o) > len(s) and o[:len(s)] == s) or (o == s and d < c) for d, o in plain.items() if d != c)}


def test_maximal_conversations(spark):
    rows = log()
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA).repartition(4)
    got = chat.render(df)
    found = {(r["conv_id"], r["part"]): r for r in got.collect()}
    kept = {c for c, _ in found}
    assert kept == brute(rows)
    assert 901 not in kept and 904 not in kept and {905, 906} <= kept
    assert [found[900, k]["part_turns"] for k in range(3)] == [1000, 1000, 500]
    assert found[900, 1]["text"].startswith("<|im_start|>user\nlong 1000<|im_end|>\n")
    assert found[905, 0]["text"] == found[906, 0]["text"] == "<|im_start|>tool\n<|im_end|>\n"
    con = duckdb.connect()
    con.register("raw", df.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM raw")
    cur = con.execute(ORACLE["op5_chat"])
    assert canon(got.columns, [tuple(r) for r in got.collect()]) == canon([d[0] for d in cur.description], cur.fetchall())


def test_empty_and_plan(spark):
    df = spark.createDataFrame([(1, 1, "user", "a", 0, "x")], SCHEMA)
    assert chat.render(df.limit(0)).count() == 0
    plan = chat.render(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
