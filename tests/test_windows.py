"""The skew-safe helpers must equal plain per-key windows, whatever the
bucket width and chunk size (small values force many buckets, chunk
boundaries and halos)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_CHECK
from tidepool.operators import metrics as M
from tidepool.operators import validate as V
from tidepool.plans import fixtures as FX
from tidepool.plans.windows import chunked_rolling, keyed_positions, last_k_per_key


def _rows(df, cols):
    return sorted(tuple(None if v is None else (round(v, 6) if isinstance(v, float) else v) for v in r)
                  for r in df.select(*cols).collect())


def _close(a, b, rel=1e-9):
    """Row lists equal up to floating-point summation order."""
    if len(a) != len(b):
        return False
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            if isinstance(x, float) and isinstance(y, float):
                if x != x and y != y:
                    continue
                if abs(x - y) > rel * max(1.0, abs(x), abs(y)):
                    return False
            elif x != y:
                return False
    return True


def _raw(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_keyed_positions_match_row_number(spark):
    r = FX.readings(spark, SF_CHECK).withColumn("one", F.lit(1))
    p = keyed_positions(r, ["device_id", "data_type"], ["ts", "seq"], bucket_seconds=7200,
                        sums=["one"], total_col="n")
    w = Window.partitionBy("device_id", "data_type").orderBy("ts", "seq")
    ref = (r.withColumn("pos", F.row_number().over(w) - 1)
            .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("device_id", "data_type"))))
    got = _rows(p.withColumn("ob", F.col("one_before").cast("long")), ["seq", "pos", "ob", "n"])
    exp = _rows(ref.withColumn("ob", F.col("pos")), ["seq", "pos", "ob", "n"])
    assert got == exp


def test_chunked_rolling_matches_plain_window(spark):
    r = FX.readings(spark, SF_CHECK)
    p = keyed_positions(r, ["device_id", "data_type"], ["ts", "seq"], bucket_seconds=3600, index_col="pos")
    got = chunked_rolling(p, ["device_id", "data_type"], "pos", 100, {
        "m": lambda f, x: F.avg("value").over(f()),
        "s": lambda f, x: F.stddev_pop("value").over(f(99)),
        "first": lambda f, x: F.first("value").over(f()),
    }, chunk_rows=100)
    w = Window.partitionBy("device_id", "data_type").orderBy("ts", "seq")
    ref = (r.withColumn("m", F.avg("value").over(w.rowsBetween(-99, 0)))
            .withColumn("s", F.stddev_pop("value").over(w.rowsBetween(-98, 0)))
            .withColumn("first", F.first("value").over(w.rowsBetween(-99, 0))))
    assert got.count() == r.count()
    assert _rows(got, ["seq", "m", "s", "first"]) == _rows(ref, ["seq", "m", "s", "first"])


def test_rolling_metrics_small_chunks_equal_default(spark):
    r = FX.readings(spark, SF_CHECK)
    cols = ["seq", "history_size"] + M.METRIC_COLUMNS
    a = M.rolling_metrics(r)
    b = M.rolling_metrics(r, bucket_seconds=1800, chunk_rows=100)
    assert _rows(a, cols) == _rows(b, cols)


def test_one_hot_key(spark):
    """Every reading on one key: the plan still splits it into buckets and chunks."""
    r = FX.readings(spark, SF_CHECK).withColumn("device_id", F.lit("hot")).withColumn("data_type", F.lit("t"))
    cols = ["seq", "history_size"] + M.METRIC_COLUMNS
    a = M.rolling_metrics(r, bucket_seconds=3600, chunk_rows=512)
    w = Window.partitionBy("device_id", "data_type").orderBy("ts", "seq").rowsBetween(-99, 0)
    ref = (r.withColumn("history_size", F.count("value").over(w))
            .withColumn("average_value", F.avg("value").over(w)))
    assert _rows(a, ["seq", "history_size", "average_value"]) == _rows(ref, ["seq", "history_size", "average_value"])
    assert a.count() == r.count()
    del cols


def test_validation_small_chunks_equal_default(spark):
    r = FX.readings(spark, SF_CHECK, with_nan=True)
    cols = ["seq", "cleaned_value", "was_modified", "history_size", "history_mean", "history_std",
            "is_anomaly", "type_average"]
    a = V.validate_readings(r, rules=FX.FIXTURE_RULES)
    b = V.validate_readings(r, rules=FX.FIXTURE_RULES, bucket_seconds=900, chunk_rows=100)
    assert _close(_raw(a, cols), _raw(b, cols))


def test_last_k_matches_row_number(spark):
    r = FX.readings(spark, SF_CHECK)
    got = last_k_per_key(r, ["data_type"], ["ts", "seq"], 7, bucket_seconds=3600)
    w = Window.partitionBy("data_type").orderBy(F.desc("ts"), F.desc("seq"))
    ref = r.withColumn("recency_rank", F.row_number().over(w)).filter("recency_rank <= 7")
    assert _rows(got, ["seq", "recency_rank"]) == _rows(ref, ["seq", "recency_rank"])


def test_rows_without_a_time_are_dealt_to_several_buckets(spark, monkeypatch):
    """A key without times: ordered by seq, in ranges of it, in both directions."""
    from pyspark.sql import functions as F

    from tidepool.plans import windows as W

    monkeypatch.setattr(W, "NO_TIME_ROWS", 10)
    df = spark.range(95).select(F.lit("k").alias("k"), F.when(F.col("id") % 19 == 18, F.timestamp_seconds("id")).alias("ts"),
                                (F.col("id") * 7 % 95 - 20).alias("seq"))
    pos = {r["seq"]: r["pos"] for r in W.keyed_positions(df, ["k"], ["ts", "seq"]).collect()}
    rows = sorted(df.collect(), key=lambda r: (r["ts"] is not None, r["ts"] and r["ts"].timestamp(), r["seq"]))
    assert pos == {r["seq"]: i for i, r in enumerate(rows)}
    last = [r["seq"] for r in sorted(W.last_k_per_key(df, ["k"], ["ts", "seq"], 30).collect(), key=lambda r: r["recency_rank"])]
    assert last == [r["seq"] for r in rows[::-1][:30]]
    buckets = df.filter("ts IS NULL").select(W.time_bucket("ts", 3600, F.col("seq")).alias("b")).distinct().count()
    assert buckets >= 9


def test_history_snapshots_have_the_digits_of_sliding_windows(spark):
    import random

    from pyspark.sql import functions as F
    from tidepool.operators import validate as V
    from tidepool.plans.windows import chunked_rolling

    rng = random.Random(7)
    rows = [(k, "t", u, 3 * u, None if u % 17 == 5 else 0.1 if k == "same" else rng.uniform(-1, 1) * 10 ** rng.randint(-9, 9))
            for k, n in (("a", 230), ("same", 60), (None, 12), ("one", 1)) for u in range(n)]
    kept = spark.createDataFrame(rows, "device_id string, data_type string, _u long, _snap_pos long, _hv double")
    hv = F.col("_hv")
    want = chunked_rolling(kept, V.KEYS, "_u", 10, {
        "_m_full": lambda f, x: F.avg(hv).over(f()),
        "_s_full": lambda f, x: F.stddev_pop(hv).over(f()),
        "_m_short": lambda f, x: F.avg(hv).over(f(9)),
        "_s_short": lambda f, x: F.stddev_pop(hv).over(f(9)),
        "_oldest": lambda f, x: F.first(hv).over(f()),
    }, 50).drop("_hv")
    got = V.history_snapshots(kept, V.KEYS, 10, 50)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == len(rows)
