"""Stream behaviour beyond the oracle: restart from a checkpoint mid-way gives
the batch result; a re-run batch write replaces instead of duplicating."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from replay_files import replay_files
from tidepool.operators import validate as V
from tidepool.plans import fixtures as FX
from tidepool.session import scratch_dir
from tidepool.sources.history import write_batch
from tidepool.streaming import replay as SR
from tidepool.streaming import commits as SC
from tidepool.streaming import tails as TL
from tidepool.streaming import windows as SW

COLS = ["seq", "cleaned_value", "was_modified", "history_size", "type_average"]


def _rows(df):
    return sorted((r[0], None if r[1] is None else round(r[1], 6), r[2], r[3],
                   None if r[4] is None else round(r[4], 6)) for r in df.select(*COLS).collect())


def test_validation_stream_resumes_from_checkpoint(spark):
    r = FX.readings(spark, SF_SMALL, with_nan=True)
    base = scratch_dir(spark, "test-resume")
    split = F.to_timestamp(F.lit("2024-01-15 00:00:00"))
    replay_files(r.filter(F.col("ts") < split), f"{base}/source", chunk_seconds=7 * 86400)

    def run():
        s = SR.read_replay(spark, f"{base}/source", r.schema)
        SR.run_available_now(lambda: TL.start_validation_stream(s, f"{base}/tables", f"{base}/checkpoint", rules=FX.FIXTURE_RULES))

    run()
    first = spark.read.parquet(f"{base}/tables/validated").count()
    # more data arrives; the query restarts from its checkpoint and state
    replay_files(r.filter(F.col("ts") >= split), f"{base}/source", chunk_seconds=7 * 86400)
    run()
    got = spark.read.parquet(f"{base}/tables/validated")
    assert 0 < first < got.count() == r.count()
    expected = V.validate_readings(r, rules=FX.FIXTURE_RULES)
    assert _rows(got) == _rows(expected)
    # the pools carried along are the sums of the histories, to the last digit
    pools = {r["data_type"]: (r["pool_sum"], r["pool_values"]) for r in TL.pool_averages(spark, f"{base}/tables").collect()}
    whole = {r["data_type"]: (r["pool_sum"], r["pool_values"]) for r in V.type_averages(FX.readings(spark, SF_SMALL, with_nan=True), rules=FX.FIXTURE_RULES).collect()}
    assert pools == whole


def test_batch_write_is_idempotent(spark):
    r = FX.readings(spark, SF_SMALL).limit(50)
    path = scratch_dir(spark, "test-idem")
    write_batch(r, path, 7)
    write_batch(r, path, 7)          # the same batch again (a retry)
    write_batch(r, path, 8)
    got = spark.read.parquet(path)
    assert got.filter("stream_batch = 7").count() == 50
    assert got.count() == 100


def test_metrics_stream_resumes_from_checkpoint(spark):
    from tidepool.operators import metrics as M

    r = FX.readings(spark, SF_SMALL)
    base = scratch_dir(spark, "test-resume-metrics")
    split = F.to_timestamp(F.lit("2024-01-15 00:00:00"))
    replay_files(r.filter(F.col("ts") < split), f"{base}/source", chunk_seconds=7 * 86400)

    def run():
        s = SR.read_replay(spark, f"{base}/source", r.schema)
        SR.run_available_now(lambda: TL.start_metrics_stream(s, f"{base}/tables", f"{base}/checkpoint"))

    run()
    replay_files(r.filter(F.col("ts") >= split), f"{base}/source", chunk_seconds=7 * 86400)
    run()
    cols = ["seq", "history_size", "average_value", "variance", "trend_coefficient", "normalized_value"]
    got = spark.read.parquet(f"{base}/tables/metrics").select(*cols)
    exp = M.rolling_metrics(r).select(*cols)

    def rows(df):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in df.collect())

    assert got.count() == r.count()
    assert rows(got) == rows(exp)


READING = "device_id string, data_type string, gateway_id string, value double, ts timestamp, seq long"


def _reading(spark, *rows):
    return spark.createDataFrame(rows, "device_id string, data_type string, gateway_id string, value double, t string, seq long").select(
        "device_id", "data_type", "gateway_id", "value", F.to_timestamp("t").alias("ts"), "seq")


def test_tails_of_null_keys_and_times(spark):
    """History rows of NULL keys and of readings without a time come back from the state."""
    base = scratch_dir(spark, "test-null-tails")
    first = _reading(spark, (None, "t", "g", 1.0, None, 0), ("d", None, "g", 2.0, "2024-01-01 00:00:01", 1), ("d", "t", "g", 3.0, None, 2))
    second = _reading(spark, (None, "t", "g", 4.0, "2024-01-02 00:00:00", 3), ("d", None, "g", 5.0, "2024-01-02 00:00:00", 4),
                      ("d", "t", "g", 6.0, "2024-01-02 00:00:00", 5), ("new", "t", "g", float("nan"), "2024-01-02 00:00:00", 6))
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(f"{base}/source")
    s = SR.read_replay(spark, f"{base}/source", READING)
    SR.run_available_now(lambda: TL.start_validation_stream(s, f"{base}/tables", f"{base}/checkpoint", rules=[]))
    got = {r["seq"]: (r["history_size"], r["cleaned_value"]) for r in spark.read.parquet(f"{base}/tables/validated").collect()}
    assert got[3] == (1, 4.0) and got[4] == (1, 5.0) and got[5] == (1, 6.0)
    assert got[6] == (0, (1.0 + 3.0 + 4.0 + 6.0) / 4)          # the live average over all devices of the type


def test_history_rule_across_batches(spark):
    """100 kept values, then one that is not: the history has 99 from then on, also after the batch ends."""
    base = scratch_dir(spark, "test-evict")
    rows = [("d", "t", "g", float(i % 7), f"2024-01-01 00:{i // 60:02}:{i % 60:02}", i) for i in range(100)]
    rows += [("d", "t", "g", float("inf"), "2024-01-01 01:00:00", 100)]
    later = [("d", "t", "g", 1.0, "2024-01-01 02:00:00", 101), ("d", "t", "g", 2.0, "2024-01-01 02:00:01", 102)]
    for part in (rows[:60], rows[60:], later):
        _reading(spark, *part).coalesce(1).write.mode("append").parquet(f"{base}/source")
    s = SR.read_replay(spark, f"{base}/source", READING)
    SR.run_available_now(lambda: TL.start_validation_stream(s, f"{base}/tables", f"{base}/checkpoint", rules=[]))
    got = {r["seq"]: r["history_size"] for r in spark.read.parquet(f"{base}/tables/validated").collect()}
    want = {r["seq"]: r["history_size"] for r in V.validate_readings(_reading(spark, *rows, *later), rules=[]).collect()}
    assert got == want and got[101] == 99 and got[102] == 100


def test_late_readings_are_counted_and_kept(spark):
    base = scratch_dir(spark, "test-late")
    files = [[("d", "t", "g", 1.0, "2024-01-01 00:00:01", 0), ("d", "t", "g", 2.0, "2024-01-01 00:10:00", 1)],
             [("d", "t", "g", 4.0, "2024-01-01 00:10:02", 2)],
             [("d", "t", "g", 8.0, "2024-01-01 00:00:02", 3), ("d", "t", "g", 16.0, "2024-01-01 00:11:00", 4)]]
    for rows in files:
        _reading(spark, *rows).coalesce(1).write.mode("append").parquet(f"{base}/source")
    sums = SW.interval_sums("1 minute")
    s = SR.read_replay(spark, f"{base}/source", READING)
    SR.run_available_now(lambda: SW.start_window_sums(s, sums, f"{base}/tables", f"{base}/checkpoint"))

    def got():
        return sorted((str(r["interval_start"])[11:16], r["total"], r["items"], r["late_items"]) for r in SW.window_sums(spark, f"{base}/tables", sums).collect())

    want = [("00:00", 9, 2, 1), ("00:10", 6, 2, 0), ("00:11", 16, 1, 0)]
    assert got() == want
    assert [r["seq"] for r in SW.late_readings(spark, f"{base}/tables", READING).collect()] == [3]
    # folding changes no sum, and batches after it add to it
    assert SW.fold_window_sums(spark, f"{base}/tables", sums) == 2 and got() == want
    _reading(spark, ("d", "t", "g", 32.0, "2024-01-01 00:00:03", 5)).coalesce(1).write.mode("append").parquet(f"{base}/source")
    SR.run_available_now(lambda: SW.start_window_sums(s, sums, f"{base}/tables", f"{base}/checkpoint"))
    assert got() == [("00:00", 41, 3, 2), *want[1:]]
    assert SW.fold_window_sums(spark, f"{base}/tables", sums) == 3 and got() == [("00:00", 41, 3, 2), *want[1:]]


def test_a_batch_killed_between_its_writes_is_invisible(spark):
    """All tables of a batch appear with its commit, and a retry completes them without duplicates."""
    root = scratch_dir(spark, "test-commits")
    one, two = spark.range(3).toDF("a"), spark.range(5).toDF("b")
    SC.write_together(spark, root, 0, {"one": one, "two": two})

    class Killed(Exception):
        pass

    class Broken(dict):
        def items(self):
            yield "one", one
            raise Killed            # after the first table of the batch was written

    try:
        SC.write_together(spark, root, 1, Broken())
    except Killed:
        pass
    assert spark.read.parquet(f"{root}/one").count() == 6           # the files are there
    for table, schema, rows in (("one", "a long", 3), ("two", "b long", 5)):
        assert SC.read_committed(spark, root, table, schema).count() == rows
    SC.write_together(spark, root, 1, {"one": one, "two": two})
    SC.write_together(spark, root, 1, {"one": one, "two": two})
    assert SC.last_commit(spark, root) == 1
    assert SC.read_committed(spark, root, "one", "a long").count() == 6 and SC.read_committed(spark, root, "two", "b long").count() == 10
    assert SC.read_committed(spark, root, "none", "c long").count() == 0


def test_folding_keeps_the_last_row_of_a_key(spark):
    root = scratch_dir(spark, "test-fold")
    schema, merge = "id string, at long, v long", SC.latest(["id"], "at")
    for n, rows in enumerate(([("a", 1, 1), ("b", 1, 1)], [("a", 3, 3)], [("a", 2, 2), (None, 1, 9)])):
        SC.write_together(spark, root, n, {"t": spark.createDataFrame(rows, schema)})

    def got():
        return sorted(map(repr, map(tuple, SC.read_merged(spark, root, "t", schema, merge).collect())))

    want = sorted(map(repr, [("a", 3, 3), ("b", 1, 1), (None, 1, 9)]))
    assert got() == want and SC.fold(spark, root, "t", schema, merge) == 2 and got() == want
    SC.write_together(spark, root, 3, {"t": spark.createDataFrame([("b", 5, 5)], schema)})
    assert got() == sorted(map(repr, [("a", 3, 3), ("b", 5, 5), (None, 1, 9)]))


def _append(spark, base, *rows):
    _reading(spark, *rows).withColumn("marker", F.lit(False)).coalesce(1).write.mode("append").parquet(f"{base}/source")


def test_envelopes_leave_once_and_late_readings_too(spark):
    from tidepool.streaming import envelopes as SE

    base = scratch_dir(spark, "test-envelopes")
    schema = f"{READING}, marker boolean"

    def run():
        s = SR.read_replay(spark, f"{base}/source", schema)
        out = SE.stream_envelopes(s, interval_seconds=30).withColumn("Data", F.to_json("Data"))
        SR.run_available_now(SR.to_parquet(out, f"{base}/out", f"{base}/checkpoint"))
        return sorted((str(r["flush_start"])[11:], r["AggregatorId"], r["late"], r["Data"]) for r in spark.read.parquet(f"{base}/out").collect())

    _append(spark, base, ("d", "t", "g", 1.0, "2024-01-01 00:00:01", 0), ("d", "s", "g", 2.0, "2024-01-01 00:00:02", 1), (None, "t", "g", 3.0, "2024-01-01 00:00:00", 2))
    _append(spark, base, ("d", "t", "g", 4.0, "2024-01-01 00:00:29", 3), ("d", "t", None, 5.0, "2024-01-01 00:10:00", 4), ("d", "t", "g", 9.0, None, 5))
    first = run()
    whole = '[{"DataType":"s","Data":[{"Value":2.0,"WavyId":"d"}]},{"DataType":"t","Data":[{"Value":3.0,"WavyId":"Unknown"},{"Value":1.0,"WavyId":"d"},{"Value":4.0,"WavyId":"d"}]}]'
    one = '[{"DataType":"t","Data":[{"Value":%s,"WavyId":"d"}]}]'
    assert first == [("00:00:00", "g", False, whole)]
    # after a restart: a reading of a window that has left goes out by itself, the open window by the marker
    _append(spark, base, ("d", "t", "g", 6.0, "2024-01-01 00:00:05", 6), ("d", "t", None, 7.0, "2024-01-01 00:10:01", 7))
    SE.flush_marker(spark, spark.read.parquet(f"{base}/source").schema, "2024-01-01 00:10:01").select(
        "device_id", "data_type", "gateway_id", "value", "ts", "seq", "marker").coalesce(1).write.mode("append").parquet(f"{base}/source")
    got = run()
    want = [*first, ("00:00:00", "g", True, one % "6.0"),
            ("00:10:00", None, False, '[{"DataType":"t","Data":[{"Value":5.0,"WavyId":"d"},{"Value":7.0,"WavyId":"d"}]}]')]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_envelope_state_is_held_by_span(spark):
    from tidepool.streaming import envelopes as SE

    base = scratch_dir(spark, "test-envelope-spans")
    rows = [("d", "t", "g", float(i), f"2024-01-01 {i // 60:02}:{i % 60:02}:00", i) for i in range(600)]
    _append(spark, base, *rows)

    def run():
        s = SR.read_replay(spark, f"{base}/source", f"{READING}, marker boolean")
        out = SE.stream_envelopes(s, interval_seconds=30).withColumn("Data", F.to_json("Data"))
        SR.run_available_now(SR.to_parquet(out, f"{base}/out", f"{base}/checkpoint", "append"))

    SR.run_available_now(SR.to_parquet(SE.stream_envelopes(SR.read_replay(spark, f"{base}/source", f"{READING}, marker boolean"), 30, "1 day"),
                                       f"{base}/held-out", f"{base}/held"))
    held = spark.read.format("statestore").option("stateVarName", "open").load(f"{base}/held").groupBy("key").count()
    # ten hours of one gateway: no state, and so no call, holds more than its hour
    assert sorted(r["count"] for r in held.collect()) == [60] * 10
    run()
    SE.flush_marker(spark, spark.read.parquet(f"{base}/source").schema, "2024-01-01 10:00:00").select(
        "device_id", "data_type", "gateway_id", "value", "ts", "seq", "marker").coalesce(1).write.mode("append").parquet(f"{base}/source")
    run()
    got = sorted((str(r["flush_start"]), r["late"], r["Data"]) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [(r[4], False, f'[{{"DataType":"t","Data":[{{"Value":{r[3]},"WavyId":"d"}}]}}]') for r in rows]


def _envelope(number, gateway, at, *items):
    data = ",".join(f'{{"DataType":"{t}","Data":[{{"Value":{v},"WavyId":"{d}"}}]}}' for d, t, v in items)
    return number, f'{{"AggregatorId":"{gateway}","Timestamp":"2024-01-01T{at}Z","Data":[{data}]}}'


def test_ingest_shows_all_tables_of_a_batch_or_none(spark, monkeypatch):
    from tidepool.streaming import ingest as SI

    base = scratch_dir(spark, "test-ingest")

    def feed(*envelopes):
        spark.createDataFrame(envelopes, "envelope_id long, payload string").coalesce(1).write.mode("append").parquet(f"{base}/source")

    def run():
        s = SR.read_replay(spark, f"{base}/source", "envelope_id long, payload string")
        SR.run_available_now(lambda: SI.start_decoding(s, f"{base}/items", f"{base}/checkpoint-items"))
        items = SR.read_replay(spark, f"{base}/items", SI.ITEM, files_per_trigger=100)
        SR.run_available_now(lambda: SI.start_ingest(items, f"{base}/tables", f"{base}/checkpoint"))

    def rows(name, schema):
        return SC.read_committed(spark, f"{base}/tables", name, schema).count()

    feed(_envelope(1, "g1", "00:00:00", ("a", "t", 1), ("b", "t", 2)), _envelope(2, "g2", "00:01:00", ("a", "t", 3)), (3, "garbage"))
    run()
    feed(_envelope(4, "g1", "00:02:00", ("a", "t", 5)))
    # the next batch is killed after its measurements and metrics
    write, seen = SC._replace, []

    def killed(df, path, column, number):
        if path.endswith(SI.REJECTS):
            raise RuntimeError("killed")
        seen.append(path.rpartition("/")[2])
        write(df, path, column, number)

    monkeypatch.setattr(SC, "_replace", killed)
    try:
        run()
        raise AssertionError("the batch was not killed")
    except Exception as e:
        assert "killed" in str(e)
    monkeypatch.undo()
    assert seen == [SI.MEASUREMENTS, SI.METRICS] and spark.read.parquet(f"{base}/tables/measurements").count() == 4
    assert rows(SI.MEASUREMENTS, SI.ITEM) == 3 and rows(SI.REJECTS, SI.ITEM) == 1 and SC.last_commit(spark, f"{base}/tables") == 0
    run()
    assert rows(SI.MEASUREMENTS, SI.ITEM) == 4 == spark.read.parquet(f"{base}/tables/measurements").count()
    m = {(r["device_id"], r["original_value"]): (r["history_size"], r["average_value"]) for r in spark.read.parquet(f"{base}/tables/metrics").collect()}
    assert m == {("a", 1.0): (1, 1.0), ("b", 2.0): (1, 2.0), ("a", 3.0): (2, 2.0), ("a", 5.0): (3, 3.0)}

    def registries():
        return ({r["device_id"]: str(r["last_seen"])[11:] for r in SI.registry(spark, f"{base}/tables", SI.DEVICES).collect()},
                {r["gateway_id"]: str(r["last_seen"])[11:] for r in SI.registry(spark, f"{base}/tables", SI.GATEWAYS).collect()},
                {(r["device_id"], r["gateway_id"]): (str(r["first_connected"])[11:], str(r["last_connected"])[11:])
                 for r in SI.registry(spark, f"{base}/tables", SI.MAPPINGS).collect()})

    want = ({"a": "00:02:00", "b": "00:00:00"}, {"g1": "00:02:00", "g2": "00:01:00"},
            {("a", "g1"): ("00:00:00", "00:02:00"), ("b", "g1"): ("00:00:00", "00:00:00"), ("a", "g2"): ("00:01:00", "00:01:00")})
    assert registries() == want
    for name in (SI.DEVICES, SI.GATEWAYS, SI.MAPPINGS):
        assert SI.fold_registry(spark, f"{base}/tables", name) == 1
    assert registries() == want


def test_published_messages_are_there_once_after_a_restart(spark):
    from tidepool.operators import subscriptions as SB

    base = scratch_dir(spark, "test-publish")
    schema = "topic string, message string"
    for rows in ([("a", "1"), ("b", "2")], [("a", "3")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/source")
        for _ in range(2):
            s = SR.read_replay(spark, f"{base}/source", schema)
            SR.run_available_now(lambda: SB.start_topic_sink(s, f"{base}/topics", f"{base}/checkpoint"))
    assert sorted(map(tuple, spark.read.text(f"{base}/topics").select("topic", "value").collect())) == [("a", "1"), ("a", "3"), ("b", "2")]


def test_presence_takes_the_last_event_however_late(spark):
    base = scratch_dir(spark, "test-presence")
    schema = "device_id string, kind string, ts timestamp, seq long"

    def feed(*rows):
        spark.createDataFrame(rows, "device_id string, kind string, t string, seq long").select(
            "device_id", "kind", F.to_timestamp("t").alias("ts"), "seq").coalesce(1).write.mode("append").parquet(f"{base}/source")
        s = SR.read_replay(spark, f"{base}/source", schema)
        SR.run_available_now(lambda: SW.start_presence(s, f"{base}/tables", f"{base}/checkpoint"))
        return {r["device_id"]: (r["state"], str(r["since"])[11:], r["connected"]) for r in SW.current_presence(spark, f"{base}/tables").collect()}

    assert feed(("a", "connect", "2024-01-01 10:00:00", 1), (None, "connect", "2024-01-01 10:00:00", 2), ("a", "disconnect", "2024-01-01 10:00:00", 3)) == {
        "a": ("disconnect", "10:00:00", False), None: ("connect", "10:00:00", True)}
    SW.fold_presence(spark, f"{base}/tables")
    assert feed(("a", "connect", "2024-01-01 09:00:00", 4), ("b", "connect", "2024-01-01 11:00:00", 5)) == {
        "a": ("disconnect", "10:00:00", False), "b": ("connect", "11:00:00", True), None: ("connect", "10:00:00", True)}


def test_inactivity_sees_every_silence_of_a_hot_device(spark):
    import random

    from tidepool.streaming import stateful as ST

    rng = random.Random(4)
    base, at, rows = scratch_dir(spark, "test-silence"), 1_704_067_200, []
    for i in range(4000):
        at += rng.choice([1, 1, 1, 5, 60]) if rng.random() > 0.01 else rng.choice([3599, 3600, 3601, 9000])
        rows.append(("d", at, i))
    times = [t for _, t, _ in rows]
    want = sorted(a for a, b in zip(times, times[1:]) if b - a > 3600)
    parts = [rows[:1500], rows[1500:]]
    for part in parts:
        rng.shuffle(part)
        spark.createDataFrame(part, "device_id string, t long, seq long").select("device_id", F.timestamp_seconds("t").alias("ts"), "seq").coalesce(1) \
            .write.mode("append").parquet(f"{base}/source")
    s = SR.read_replay(spark, f"{base}/source", "device_id string, ts timestamp, seq long")
    SR.run_available_now(SR.to_parquet(ST.stream_inactivity(s), f"{base}/out", f"{base}/checkpoint"))
    got = sorted(r["t"] for r in spark.read.parquet(f"{base}/out").select(F.unix_seconds("inactive_since").alias("t")).collect())
    assert got == want and len(want) > 10
