"""Hand-worked cases (FIXTURES.md section 3) on small inline frames."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidepool.functions.scalar import elapsed_hms
from tidepool.operators import batching as B
from tidepool.operators import metrics as M
from tidepool.operators import registry as G
from tidepool.operators import retention as RT
from tidepool.operators import validate as V
from tidepool.sources import decode as D
from tidepool.sources import encode as EN

T0 = datetime(2024, 1, 1)
NAN, INF = float("nan"), float("inf")


def readings(spark, rows):
    """rows: (device, type, value) in arrival order."""
    data = [(d, t, float(v), T0 + timedelta(seconds=i), i) for i, (d, t, v) in enumerate(rows)]
    return spark.createDataFrame(data, "device_id string, data_type string, value double, ts timestamp, seq long")


def validated(spark, rows):
    out = V.validate_readings(readings(spark, rows), bucket_seconds=60, chunk_rows=128)
    return {r["seq"]: r for r in out.collect()}


@pytest.mark.parametrize("dtype,value,cleaned,modified,msg", [
    ("Temperature", 20, 20, False, "Valid data"),
    ("Temperature", -50, -10, True, "Value below minimum (-10), set to minimum"),
    ("Frequency", 2000, 1000, True, "Value above maximum (1000), set to maximum"),
    ("Temperature", 50, 50, False, "Valid data"),
    ("Salinity", 1e9, 1e9, False, "Valid data"),
    ("Frequency", NAN, 0.0, True, "Invalid value (NaN or Infinity), replaced with average"),
    ("Temperature", INF, 0.0, True, "Invalid value (NaN or Infinity), replaced with average"),
])
def test_single_reading_cleaning(spark, dtype, value, cleaned, modified, msg):
    r = validated(spark, [("d1", dtype, value)])[0]
    assert r["cleaned_value"] == cleaned
    assert r["was_modified"] is modified
    assert r["validation_message"] == msg


def test_nan_uses_average_over_all_devices(spark):
    r = validated(spark, [("d1", "Temperature", 10), ("d2", "Temperature", 20), ("d1", "Temperature", NAN)])
    assert r[2]["cleaned_value"] == 15.0


def test_anomaly_needs_five_values(spark):
    r = validated(spark, [("d", "Temperature", v) for v in (10, 11, 12, 13, 49)])
    assert r[4]["history_size"] == 4 and r[4]["is_anomaly"] is False


def test_anomaly_flat_history(spark):
    r = validated(spark, [("d", "Temperature", 10.0)] * 5 + [("d", "Temperature", 10.1)])
    assert r[5]["is_anomaly"] is True
    assert r[5]["anomaly_message"].startswith("Possible anomaly: value deviates significantly from history")


def test_anomaly_nan_never_flags(spark):
    r = validated(spark, [("d", "Temperature", v) for v in (10, 11, 12, 13, 14)] + [("d", "Temperature", NAN)])
    assert r[5]["is_anomaly"] is False


def _history_case(extra):
    vals = [float(i % 40) for i in range(100)]
    return vals, [("d", "Temperature", v) for v in vals] + extra


def test_history_eviction_after_one_modified(spark):
    vals, rows = _history_case([("d", "Temperature", 999), ("d", "Temperature", 20)])
    r = validated(spark, rows)
    assert r[101]["history_size"] == 99
    assert r[101]["history_mean"] == pytest.approx(sum(vals[1:]) / 99)


def test_history_eviction_after_two_modified(spark):
    vals, rows = _history_case([("d", "Temperature", 999), ("d", "Temperature", 999), ("d", "Temperature", 20)])
    r = validated(spark, rows)
    assert r[102]["history_size"] == 99
    assert r[102]["history_mean"] == pytest.approx(sum(vals[1:]) / 99)


def test_history_refill(spark):
    vals, rows = _history_case([("d", "Temperature", 999), ("d", "Temperature", 21), ("d", "Temperature", 5)])
    r = validated(spark, rows)
    assert r[102]["history_size"] == 100
    assert r[102]["history_mean"] == pytest.approx((sum(vals[1:]) + 21) / 100)


def test_batch_status(spark):
    rows = [(1, "T", False), (1, "T", False), (2, "T", True), (2, "T", False), (3, None, None)]
    df = spark.createDataFrame(rows, "batch long, data_type string, was_modified boolean")
    s = {r["batch"]: (r["status"], r["status_code"], r["total_items"]) for r in V.batch_status(df, ["batch"]).collect()}
    assert s == {1: ("OK", 0, 2), 2: ("PARTIALLY_VALID", 2, 2), 3: ("INVALID", 1, 0)}


def _metrics(spark, values):
    out = M.rolling_metrics(readings(spark, [("d", "T", v) for v in values]), bucket_seconds=60, chunk_rows=128)
    return {r["seq"]: r for r in out.collect()}


@pytest.mark.parametrize("values,avg,var,trend,z", [
    ([5], 5, 0, 0, 0),
    ([4, 6], 5, 1, 0, 1),
    ([1, 2, 3], 2, 2 / 3, 1, 1.224745),
    ([3, 2, 1], 2, 2 / 3, -1, -1.224745),
])
def test_metrics_small(spark, values, avg, var, trend, z):
    r = _metrics(spark, values)[len(values) - 1]
    assert r["average_value"] == pytest.approx(avg)
    assert r["variance"] == pytest.approx(var)
    assert r["trend_coefficient"] == pytest.approx(trend)
    assert r["normalized_value"] == pytest.approx(z, abs=1e-6)
    assert r["anomaly_score"] == pytest.approx(abs(z), abs=1e-6)


def test_metrics_cap(spark):
    r = _metrics(spark, [0.0] + [1.0] * 100)[100]
    assert r["history_size"] == 100
    assert (r["average_value"], r["variance"], r["normalized_value"]) == (1.0, 0.0, 0.0)


def _items(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(F.try_parse_json("t").alias("i"))


def test_device_id_extraction(spark):
    i = _items(spark, ['{"wavyId":"a"}', '{"WavyId":""}', '{}'])
    assert [r[0] for r in i.select(D.device_id_of(F.col("i"))).collect()] == ["a", "Unknown", "Unknown"]


def test_strict_value(spark):
    i = _items(spark, ['{"Value":"1.5"}', '{"Value":"x","value":2}', '{"value":2}', '{}', '{"Value":"1d"}'])
    assert [r[0] for r in i.select(D.strict_value_of(F.col("i"))).collect()] == [1.5, None, 2.0, None, None]


def test_lenient_value(spark):
    i = _items(spark, ['{"Value":"x"}', '{}'])
    assert [r[0] for r in i.select(D.lenient_value_of(F.col("i"))).collect()] == [0.0, 0.0]


def test_detect_format(spark):
    df = spark.createDataFrame([("XML:<a/>",), ("JSON:{}",), ("{}",)], "message string")
    got = [(r["format"], r["content"]) for r in D.detect_format(df).collect()]
    assert got == [("XML", "<a/>"), ("JSON", "{}"), ("JSON", "{}")]


def test_frame_decode_and_roundtrip(spark):
    df = spark.createDataFrame([(bytes.fromhex("2D010000") + b"{}",)], "frame binary")
    r = D.decode_frames(df).first()
    assert (r["code"], r["payload"]) == (301, "{}")
    enc = spark.range(1).select(EN.encode_frame(F.lit(301), F.lit("{}")).alias("frame"))
    assert bytes(enc.first()[0]) == bytes.fromhex("2D010000") + b"{}"


def test_xml_roundtrip(spark):
    df = spark.createDataFrame([("d<1>", "T&x", 12.5)], "device_id string, data_type string, value double")
    x = df.select(EN.reading_xml("data_type", EN.number_text("value"), "device_id").alias("x"))
    m = x.select(D.xml_to_map("x").alias("m")).first()["m"]
    assert m == {"WavyId": "d<1>", "DataType": "T&x", "Value": "12.5"}
    bad = spark.createDataFrame([("<bad",)], "x string").select(D.xml_to_map("x")).first()[0]
    assert bad is None


def test_mapping_first_and_last(spark):
    t1, t2 = T0, T0 + timedelta(hours=1)
    df = spark.createDataFrame([("d", "g", t1, 1), ("d", "g", t2, 2)],
                               "device_id string, gateway_id string, ts timestamp, seq long")
    r = G.mapping_upsert(None, df).first()
    assert (r["first_connected"], r["last_connected"]) == (t1, t2)


def test_retention_boundary_is_strict(spark):
    now = T0 + timedelta(hours=5)
    reg = spark.createDataFrame([("a", now - timedelta(hours=1)), ("b", now - timedelta(hours=1, seconds=1))],
                                "device_id string, last_seen timestamp")
    got = [r[0] for r in RT.inactive(reg, F.lit(now)).collect()]
    assert got == ["b"]


def test_elapsed_drops_days(spark):
    s = 25 * 3600 + 3 * 60 + 4
    assert spark.range(1).select(elapsed_hms(F.lit(s))).first()[0] == "1h 3m 4s"


def test_interval_sum(spark):
    df = readings(spark, [("d", "T", 3), ("d", "W", 5), ("d", "T", 4.9)])
    got = {r["data_type"]: r["total"] for r in B.interval_sum(df).collect()}
    assert got == {"T": 7, "W": 5}
    assert not math.isnan(got["T"])


def test_request_xml_roundtrip(spark):
    df = spark.createDataFrame([("subscribe", "Temperature")], "action string, data_type string")
    x = df.select(EN.request_xml("action", "data_type").alias("x"))
    fields = (("action", False), ("dataType", False))
    tagged = x.select(EN.tag_message(F.lit("XML"), F.col("x")).alias("message"))
    m = D.decode_tagged(tagged, xml_fields=fields).first()["fields"]
    assert m == {"action": "subscribe", "dataType": "Temperature"}
    assert x.select(D.xml_to_map("x")).first()[0] == {"action": "subscribe", "dataType": "Temperature"}


def test_topic_sink(spark, tmp_path):
    from tidepool.operators.subscriptions import write_topics

    msgs = spark.createDataFrame([("T", "JSON:{}"), ("W", "XML:<a/>")], "topic string, message string")
    write_topics(msgs, str(tmp_path / "topics"))
    back = spark.read.text(str(tmp_path / "topics")).collect()
    assert sorted((r["topic"], r["value"]) for r in back) == [("T", "JSON:{}"), ("W", "XML:<a/>")]


# -- rows that must not get lost, and rows that must not stop a job ------------

def test_null_ids_and_times_keep_their_rows(spark):
    from tidepool.operators import metrics as M, validate as V

    rows = [(None, "t", 1.0, None, 0), (None, "t", 2.0, "2024-01-01 00:00:01", 1), ("d", "t", 3.0, None, 2),
            ("d", None, 4.0, "2024-01-01 00:00:02", 3), ("d", "t", 5.0, "2024-01-01 00:00:03", 4), ("d", "t", 5.0, "2024-01-01 00:00:03", 4)]
    df = spark.createDataFrame(rows, "device_id string, data_type string, value double, ts string, seq long").withColumn("ts", F.to_timestamp("ts"))
    m = {(r["device_id"], r["data_type"], r["seq"]): r["history_size"] for r in M.rolling_metrics(df).collect()}
    assert M.rolling_metrics(df).count() == V.validate_readings(df).count() == M.last_n_history(df).count() == len(rows)
    assert m[(None, "t", 0)] == 1 and m[(None, "t", 1)] == 2 and m[("d", "t", 2)] == 1 and m[("d", None, 3)] == 1
    assert M.metrics_with_fallback(df.withColumn("value", F.when(F.col("seq") != 1, F.col("value")))).count() == len(rows)


def test_prefix_gate_keeps_equal_readings(spark):
    from tidepool.operators.subscriptions import subscribed_readings

    r = spark.createDataFrame([("view", 1), ("view", 1), ("vast", 1), ("click", 2), ("", 3), (None, 4)], "data_type string, seq long")
    topics = spark.createDataFrame([("v",), ("vi",), ("v",)], "data_type string")
    assert sorted(x["data_type"] for x in subscribed_readings(r, topics, prefix=True).collect()) == ["vast", "view", "view"]
    every = spark.createDataFrame([("",)], "data_type string")
    assert subscribed_readings(r, every, prefix=True).count() == 5


def test_interval_sum_with_values_that_are_no_integers(spark):
    from tidepool.operators.batching import interval_sum

    rows = [("d", "t", float("nan"), "2024-01-01 00:00:01"), ("d", "t", float("inf"), "2024-01-01 00:00:01"), ("d", "t", -2.9, "2024-01-01 00:00:02")]
    df = spark.createDataFrame(rows, "device_id string, data_type string, value double, ts string").withColumn("ts", F.to_timestamp("ts"))
    r = interval_sum(df).first()
    assert (r["total"], r["items"]) == (-2, 3)


def test_late_reading_does_not_move_last_seen_back():
    import pandas as pd

    from tidepool.streaming.stateful import _inactivity_fn

    class State:
        exists, hasTimedOut, value = False, False, None
        get = property(lambda self: self.value)

        def update(self, v):
            self.exists, self.value = True, v

        def setTimeoutTimestamp(self, _):
            pass

        def getCurrentWatermarkMs(self):
            return 0

    state, fn, out = State(), _inactivity_fn(1.0), []
    for n, times in enumerate((["10:00:50"], ["10:00:20"], ["11:00:40"], ["12:30:00"])):
        pdf = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 " + t for t in times]), "seq": [n]})
        out += [r for f in fn(("d",), iter([pdf]), state) for r in f.to_dict("records")]
    assert [str(r["inactive_since"]) for r in out] == ["2024-01-01 11:00:40"]


# -- decoding: what a parser of the format would say ----------------------------

def test_xml_general_documents(spark):
    cases = [("<S id='&#233;&#x41;' a=\"x &lt; y\"><v>1&amp;<![CDATA[<m>]]></v><v> 2</v></S>", {"id": "éA", "a": "x < y", "v": " 2"}),
             ("<S><n>t<i>in</i>ner</n><o><p>9</p><q>8</q></o></S>", {"n": "tinner", "o": "98"}),
             ("<S xmlns:u='k'><u:x>7</u:x><e/><w> </w><c><![CDATA[ ]]></c></S>", {"xmlns:u": "k", "u:x": "7", "e": "", "w": "", "c": " "}),
             ("<?xml version='1.0'?>\n<!-- c --><S/>", {}), ("<S><a>1</b></S>", None), ("no root", None), ("", None), (None, None),
             ("<!DOCTYPE S [<!ENTITY x 'y'>]><S>&x;</S>", None), ("<S a='1' a='2'/>", None), ("<v>1</v>", {}), ("<S><id>1</id></S>tail", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, x string")
    got = {r["i"]: r["m"] for r in df.select("i", D.xml_to_map("x").alias("m")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_last_of_a_repeated_json_name_counts(spark):
    df = spark.createDataFrame([('{"a":"1","b":2.50,"a":"3","c":null}',), ("{}",), ("[1",)], "s string")
    got = [r[0] for r in df.select(D.json_to_map("s")).collect()]
    assert (got[0]["a"], float(got[0]["b"])) == ("3", 2.5) and got[1:] == [{}, None]
    batch = spark.createDataFrame([('{"WavyId":"x","WavyId":"y","Data":[{"DataType":"t","Value":1,"Value":5}]}',)], "payload string")
    r = D.parse_device_batch(batch).first()
    assert (r["device_id"], r["value"], r["reject_reason"]) == ("y", 5.0, None)


def test_batch_without_a_key_keeps_its_readings(spark):
    from tidepool.operators import validate as V

    rows = spark.createDataFrame([(None, "t", False), (1, "t", True), (2, None, None)], "batch_id long, data_type string, was_modified boolean")
    kept = V.drop_invalid_batches(rows, V.batch_status(rows, ["batch_id"]), ["batch_id"])
    assert sorted(map(repr, (r["batch_id"] for r in kept.collect()))) == ["1", "None"]


def _gate_by_hand(readings, control, default):
    out = {}
    for i, kind, at in readings:
        own = [(t, s, a) for k, t, s, a in control if k is not None and t is not None and k == kind and at is not None and t <= at]
        action = max(own)[2] if own else None
        out[i] = (action, action == "subscribe" if action else kind in default)
    return out


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_gate_equals_a_lookup_by_hand(spark, broadcast):
    import random

    from tidepool.operators import subscriptions as SB

    rng = random.Random(3)
    times = [T0 + timedelta(seconds=rng.randrange(500)) for _ in range(200)]
    control = [(rng.choice(["a", "b", None]), rng.choice(times[:40]), s, rng.choice(["subscribe", "unsubscribe"])) for s in range(60)]
    control.append(("a", None, 99, "subscribe"))
    readings = [(i, rng.choice(["a", "b", "c", None]), rng.choice([*times, None, T0 - timedelta(days=1), T0 + timedelta(days=9)])) for i in range(400)]
    r = spark.createDataFrame(readings, "seq long, data_type string, ts timestamp")
    c = spark.createDataFrame(control, "data_type string, ts timestamp, seq long, action string")
    for buckets in (1, 7, 1000):
        g = SB.subscription_gate(r, c, default=["c"], broadcast_actions=broadcast, buckets=buckets)
        assert {x["seq"]: (x["gate_action"], x["subscribed"]) for x in g.collect()} == _gate_by_hand(readings, control, ["c"])
    none = SB.subscription_gate(r, c.limit(0), default=["c"])
    assert {x["seq"]: x["subscribed"] for x in none.collect()} == {i: k == "c" for i, k, _ in readings}


# -- stored tables ---------------------------------------------------------------

def _files(folder):
    import os

    return {d: sorted((f, os.stat(os.path.join(top, f)).st_mtime_ns) for f in names if f.endswith(".parquet"))
            for top, _, names in os.walk(folder) if (d := os.path.relpath(top, folder)) != "."}


def test_upsert_rewrites_touched_buckets_only(spark):
    from tidepool.operators.registry import registry_upsert
    from tidepool.session import scratch_dir
    from tidepool.sources import stored as TS

    path = scratch_dir(spark, "upsert").removeprefix("file:")
    r = spark.range(300).select((F.col("id") % 100).cast("string").alias("device_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"))
    merge = TS.merge_registry("device_id")
    assert len(TS.upsert(path, r, ["device_id"], merge, buckets=16)) == 16
    before = _files(path)
    late = spark.createDataFrame([("7", 5000), (None, 5001)], "device_id string, seq long").select("device_id", F.timestamp_seconds("seq").alias("ts"), "seq")
    touched = TS.upsert(path, late, ["device_id"], merge, buckets=16)
    after = _files(path)
    assert 1 <= len(touched) <= 2 and {d for d in after if after[d] != before.get(d)} == {f"bucket={b}" for b in touched}
    for _ in range(2):                                    # a retry changes nothing
        TS.upsert(path, late, ["device_id"], merge, buckets=16)
    want = registry_upsert(registry_upsert(None, r, ["device_id"]), late, ["device_id"])
    assert sorted(map(repr, TS.read_stored(spark, path).collect())) == sorted(map(repr, want.collect()))
    assert TS.upsert(path, late.limit(0), ["device_id"], merge, buckets=16) == []


def _stored_tables(spark, rows):
    from tidepool.session import scratch_dir
    from tidepool.sources import history as H
    from tidepool.sources import stored as TS

    base = scratch_dir(spark, "stored").removeprefix("file:")
    at = TS.Registries(*[f"{base}/{t}" for t in TS.Registries._fields])
    r = spark.createDataFrame(rows, "device_id string, gateway_id string, data_type string, value double, ts timestamp, seq long")
    H.write_measurements(r, at.measurements)
    TS.upsert_registries(r, at, buckets=4)
    return at, base


def test_retention_run_on_stored_tables(spark):
    from tidepool.sources import stored as TS

    now = T0 + timedelta(days=3)
    rows = [("old", "g1", "a b/c", 1.0, T0, 0), ("old", "g1", "t", 2.0, T0 + timedelta(days=1), 1), ("new", "gone", "u", 6.0, T0, 2),
            ("new", "g1", "t", 3.0, T0 + timedelta(days=1), 3), ("new", "g1", "t", 4.0, now, 4), ("old", "gone", None, 5.0, T0, 5), (None, "g1", "t", 7.0, now, 6)]
    at, base = _stored_tables(spark, rows)
    before = _files(base)
    plan = TS.plan_retention(spark, at, F.lit(now))
    counts = {r["table_name"]: (r["before_rows"], r["after_rows"], r["removed_rows"]) for r in plan.report(spark).collect()}
    assert counts == {"measurements": (7, 3, 4), "mappings": (5, 2, 3), "devices": (3, 2, 1), "gateways": (2, 1, 1)}
    assert _files(base) == before                         # a run that is only planned changes nothing
    TS.execute_retention(spark, plan)
    left = spark.read.parquet(at.measurements)
    assert sorted(r["seq"] for r in left.collect()) == [3, 4, 6]
    for name, (_, rest, _) in counts.items():
        assert spark.read.parquet(getattr(at, name)).count() == rest
    after = _files(base)
    days = [d for d in after if d.startswith("measurements/") and "day=" in d]
    assert len(days) == 2 and all("data_type=t" in d for d in days)                     # the others held dead rows only
    assert [d for d in days if after[d] == before[d]] == [d for d in days if str(now.date()) in d]
    again = TS.plan_retention(spark, at, F.lit(now))
    assert all(t.dead == 0 for t in again.tables)
    TS.execute_retention(spark, again)
    assert _files(base) == after


def test_killed_retention_run_is_mended_by_the_next(spark, monkeypatch):
    from tidepool.sources import stored as TS

    now = T0 + timedelta(days=3)
    rows = [(d, "g", "t", 1.0, T0 + timedelta(days=3 * (d == "new")), i) for i, d in enumerate(["old", "new"] * 3)]
    at, _ = _stored_tables(spark, rows)
    plan = TS.plan_retention(spark, at, F.lit(now))

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(TS, "drop_folders", killed)
    with pytest.raises(RuntimeError):
        TS.execute_retention(spark, plan)
    monkeypatch.undo()
    TS.execute_retention(spark, TS.plan_retention(spark, at, F.lit(now)))
    assert {r["device_id"] for r in spark.read.parquet(at.measurements).collect()} == {"new"}
    assert [r["device_id"] for r in TS.read_stored(spark, at.devices).collect()] == ["new"]


# -- validation, replayed row by row -----------------------------------------------

class _Service:
    """The rules as stated: one history per device and type, looked at and changed reading by reading."""

    def __init__(self, rules):
        self.rules, self.histories = {t: (lo, hi) for t, lo, hi in rules}, {}

    def read(self, device, kind, value):
        history = self.histories.setdefault((device, kind), [])
        lo, hi = self.rules.get(kind, (-math.inf, math.inf))
        cleaned, modified = value, False
        if value < lo:
            cleaned, modified = lo, True
        elif value > hi:
            cleaned, modified = hi, True
        pool = [v for (_, k), h in self.histories.items() if k == kind for v in h]
        if math.isnan(value) or math.isinf(value):
            cleaned, modified = (sum(pool) / len(pool) if pool else 0.0), True
        size = len(history)
        mean = sum(history) / size if size else None
        sigma = math.sqrt(sum((v - mean) ** 2 for v in history) / size) if size else None
        anomaly = size >= 5 and not math.isnan(value) and abs(value - mean) > 3 * sigma
        if size >= 100:
            history.pop(0)
        if not modified:
            history.append(value)
        return size, mean, sigma, anomaly, cleaned, modified

    def pools(self):
        out = {}
        for (_, kind), h in self.histories.items():
            out.setdefault(kind, []).extend(h)
        return {k: (len(v), sum(v)) for k, v in out.items() if v}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_validation_equals_a_replay_row_by_row(spark, seed):
    import random

    from tidepool.operators import validate as V

    rng = random.Random(seed)
    rules = [("t", 0.0, 100.0), ("u", -5.0, 5.0)]
    bad = [0.02, 0.5, 0.9][seed - 1]                      # share of readings that are not kept
    rows = []
    for seq in range(1500):
        kind = rng.choice(["t", "u", "free", None])
        value = rng.gauss(50, 20) if kind == "t" else rng.gauss(0, 2)
        if rng.random() < bad:
            value = rng.choice([1e6, -1e6, float("nan"), float("inf"), -float("inf")])
        rows.append((rng.choice(["a", "b", None]), kind, value, T0 + timedelta(seconds=rng.randrange(4) + seq), seq))
    rows.sort(key=lambda r: (r[3], r[4]))
    service = _Service(rules)
    want = {r[4]: service.read(*r[:3]) for r in rows}
    df = spark.createDataFrame(rows, "device_id string, data_type string, value double, ts timestamp, seq long").repartition(5)
    got = V.validate_readings(df, rules=rules, bucket_seconds=300, chunk_rows=128).collect()
    assert len(got) == len(rows)
    for r in got:
        size, mean, sigma, anomaly, cleaned, modified = want[r["seq"]]
        assert (r["history_size"], r["is_anomaly"], r["was_modified"]) == (size, anomaly, modified)
        assert r["cleaned_value"] == pytest.approx(cleaned, rel=1e-9, abs=1e-9)
        if size:
            assert r["history_mean"] == pytest.approx(mean, rel=1e-9, abs=1e-9) and r["history_std"] == pytest.approx(sigma, rel=1e-6, abs=1e-6)
    pools = {r["data_type"]: (r["pool_values"], float(r["pool_sum"])) for r in V.type_averages(df, rules=rules).collect()}
    assert pools == {k: (n, pytest.approx(s, rel=1e-9, abs=1e-9)) for k, (n, s) in service.pools().items()}


def test_pool_sums_do_not_depend_on_the_partitioning(spark):
    from tidepool.operators import validate as V

    rows = [("d%d" % (i % 7), "t", (i * 0.1 + 1e9 * (i % 3) - 1e-7 * i), T0 + timedelta(seconds=i), i) for i in range(400)]
    df = spark.createDataFrame(rows, "device_id string, data_type string, value double, ts timestamp, seq long")
    found = set()
    for parts in (1, 3, 8):
        a = V.validate_readings(df.withColumn("value", F.when(F.col("seq") % 50 == 49, float("nan")).otherwise(F.col("value"))).repartition(parts), rules=[])
        found.add(tuple(sorted((r["seq"], r["cleaned_value"], r["type_average"]) for r in a.filter("seq % 50 = 49").collect())))
        found.add(("sum", str(V.type_averages(df.repartition(parts), rules=[]).first()["pool_sum"])))
    assert len(found) == 2
