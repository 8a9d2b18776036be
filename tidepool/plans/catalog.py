"""Query catalogue: one entry per operator of the inventory.

Each query takes ``(spark, sf_dir)``, reads the given tables (or views derived
from them by Spark) and returns a DataFrame whose column names match the SQL
oracle in ``plans.oracle``.  Doubles are rounded here (never in the library) so
that two engines agree on the last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import metrics as M
from tidepool.plans import fixtures as FX
from tidepool.operators import batching as B
from tidepool.operators import registry as G
from tidepool.operators import retention as RT
from tidepool.operators import subscriptions as SB
from tidepool.operators import validate as V
from tidepool.schema import DATA_FIELD, GATEWAY_FIELD, ID_FIELD, TIME_FIELD, TYPE_FIELD, VALUE_FIELD
from tidepool.session import scratch_dir
from tidepool.sources import decode as D
from tidepool.sources import encode as EN
from tidepool.sources import history as H
from tidepool.sources import stored as TS
from tidepool.streaming import commits as SC
from tidepool.streaming import envelopes as SE
from tidepool.streaming import ingest as SI
from tidepool.streaming import replay as SR
from tidepool.streaming import sinks as SS
from tidepool.streaming import stateful as ST
from tidepool.streaming import tails as TL
from tidepool.streaming import windows as SW

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Day and hour windows are defined on UTC; pin the session zone.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run
    return deco


def rnd(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(3.3e-8), 6)


def ntz(c: str = "ts") -> Column:
    return F.col(c).cast("timestamp_ntz").alias(c)


# --------------------------------------------------------------------------
# Rolling metrics
# --------------------------------------------------------------------------

@query("rolling_metrics")
def q_rolling_metrics(spark, sf_dir):
    """Mean, variance, std, trend, z and score over the last 100 readings."""
    r = FX.readings(spark, sf_dir)
    m = M.rolling_metrics(r)
    return m.select("device_id", "data_type", "seq", ntz("ts"),
                    F.col("value").alias("original_value"),
                    F.col("history_size").cast("long").alias("history_size"),
                    *[rnd(c).alias(c) for c in M.METRIC_COLUMNS])


# --------------------------------------------------------------------------
# Validation and cleaning
# --------------------------------------------------------------------------


def _validated(spark, sf_dir):
    r = FX.readings(spark, sf_dir, with_nan=True)
    return V.validate_readings(r, rules=FX.FIXTURE_RULES)


@query("clean_readings")
def q_clean_readings(spark, sf_dir):
    """Rule lookup (unknown type unbounded), clamp, flag, message."""
    r = FX.readings(spark, sf_dir, with_nan=True)
    c = V.clean_readings(r, rules=FX.fixture_rules(spark))
    return c.select("device_id", "data_type", "seq", F.col("value").alias("original_value"),
                    "min_value", "max_value", "cleaned_value", "was_modified", "validation_message")


@query("history_anomaly")
def q_history_anomaly(spark, sf_dir):
    """Valid-only history (99/100 rule), its mean and sigma before
    the reading, and the 3-sigma flag."""
    v = V.history_statistics(FX.readings(spark, sf_dir, with_nan=True), rules=FX.FIXTURE_RULES)
    return v.select("device_id", "data_type", "seq", "was_modified", "history_size",
                    rnd("history_mean").alias("history_mean"), rnd("history_std").alias("history_std"),
                    "is_anomaly", "anomaly_message")


@query("replace_nonfinite")
def q_replace_nonfinite(spark, sf_dir):
    """Non-finite values replaced by the live cross-device average of
    the type (0.0 without history); full cleaned output."""
    v = _validated(spark, sf_dir)
    return v.select("device_id", "data_type", "seq", "original_value",
                    rnd("cleaned_value").alias("cleaned_value"), "was_modified",
                    "validation_message", rnd("type_average").alias("type_average"))


@query("history_pool")
def q_history_pool(spark, sf_dir):
    """Average per type over the union of all devices' current histories."""
    r = FX.readings(spark, sf_dir, with_nan=True)
    a = V.type_averages(r, rules=FX.FIXTURE_RULES)
    return a.select("data_type", F.col("pool_values").cast("long").alias("pool_values"),
                    rnd("pool_sum").alias("pool_sum"), rnd("type_average").alias("type_average"))


def _batches(spark, sf_dir):
    """Cleaned readings (whether one was modified needs no history) with their batch
    (event_id div 8), plus one empty batch (-1), as a request without items."""
    r = FX.readings(spark, sf_dir, with_nan=True)
    v = V.clean_readings(r, rules=FX.FIXTURE_RULES).withColumn("batch_id", F.floor(F.col("seq") / FX.BATCH_SIZE).cast("long"))
    empty = (spark.range(1).select(F.lit(-1).cast("long").alias("batch_id"))
             .withColumn("data_type", F.lit(None).cast("string"))
             .withColumn("was_modified", F.lit(None).cast("boolean")))
    return v.select("batch_id", "data_type", "was_modified").unionByName(empty)


@query("batch_status")
def q_batch_status(spark, sf_dir):
    """Per batch item and modified counts, status, code and message."""
    s = V.batch_status(_batches(spark, sf_dir), ["batch_id"])
    return s.select("batch_id", F.col("total_items").cast("long").alias("total_items"),
                    F.col("modified_items").cast("long").alias("modified_items"),
                    "status", F.col("status_code").cast("long").alias("status_code"), "status_message")


@query("batch_summary")
def q_batch_summary(spark, sf_dir):
    """Batches and items per status; items of INVALID batches are
    dropped (kept_items counts what goes on)."""
    b = _batches(spark, sf_dir)
    s = V.batch_status(b, ["batch_id"])
    kept = V.drop_invalid_batches(b.filter(F.col("data_type").isNotNull()), s, ["batch_id"])
    kept_per = kept.groupBy("batch_id").agg(F.count(F.lit(1)).alias("kept"))
    j = s.join(kept_per, "batch_id", "left")
    return j.groupBy("status").agg(
        F.count(F.lit(1)).cast("long").alias("batches"),
        F.sum("total_items").cast("long").alias("total_items"),
        F.sum("modified_items").cast("long").alias("modified_items"),
        F.coalesce(F.sum("kept"), F.lit(0)).cast("long").alias("kept_items"))


# --------------------------------------------------------------------------
# Metric extras: regression, long form, classes, context, snapshot, fallback
# --------------------------------------------------------------------------

@query("rolling_regression")
def q_rolling_regression(spark, sf_dir):
    """Rolling least-squares line over the last 100 readings (x = position
    in the frame, 0 = oldest): slope, intercept, r2."""
    m = M.rolling_metrics(FX.readings(spark, sf_dir), regression=True)
    return m.select("device_id", "data_type", "seq", F.col("history_size").cast("long").alias("history_size"),
                    rnd("slope").alias("slope"), rnd("intercept").alias("intercept"), rnd("r2").alias("r2"))


@query("metrics_long")
def q_metrics_long(spark, sf_dir):
    """Metrics unpivoted to (metric_type, metric_value) with the frame's
    time range."""
    m = M.rolling_metrics(FX.readings(spark, sf_dir), regression=True)
    lf = M.metrics_long(m)
    return lf.select("device_id", "data_type", "seq", ntz("window_start"), ntz("window_end"),
                     "metric_type", rnd("metric_value").alias("metric_value"))


@query("anomaly_class")
def q_anomaly_class(spark, sf_dir):
    """Anomaly / warning / normal from the rolling z-score."""
    m = M.classify_anomaly(M.rolling_metrics(FX.readings(spark, sf_dir)))
    return m.select("device_id", "data_type", "seq", rnd("anomaly_score").alias("anomaly_score"),
                    "anomaly_class")


@query("contextual_anomaly")
def q_contextual_anomaly(spark, sf_dir):
    """Each reading against the previous day's statistics of its key."""
    c = M.contextual_anomaly(FX.readings(spark, sf_dir))
    return c.select("device_id", "data_type", "seq", ntz("period_start"),
                    F.coalesce(F.col("prev_n"), F.lit(0)).cast("long").alias("prev_n"),
                    rnd("prev_mean").alias("prev_mean"), rnd("prev_std").alias("prev_std"),
                    "contextual_anomaly")


@query("last_100")
def q_last_100(spark, sf_dir):
    """The bounded history snapshot (last 100 readings per key)."""
    h = M.last_n_history(FX.readings(spark, sf_dir))
    return h.select("device_id", "data_type", "seq", ntz("ts"), "value", "recency_rank")


@query("metrics_with_fallback")
def q_metrics_with_fallback(spark, sf_dir):
    """Every measurement kept; metrics NULL where they cannot be computed."""
    m = M.metrics_with_fallback(FX.readings(spark, sf_dir, with_nan=True))
    return m.select("device_id", "gateway_id", "data_type", "seq", F.col("value").alias("original_value"),
                    F.col("history_size").cast("long").alias("history_size"),
                    rnd("average_value").alias("average_value"), rnd("variance").alias("variance"),
                    rnd("anomaly_score").alias("anomaly_score"), "metrics_ok")


# --------------------------------------------------------------------------
# Batching, registry, presence, retention, subscriptions
# --------------------------------------------------------------------------


@query("interval_sum")
def q_interval_sum(spark, sf_dir):
    """Per device, type and interval the sum of truncated values
    (7 s on the wire; 1 hour on this sparse table)."""
    s = B.interval_sum(FX.readings(spark, sf_dir), interval="1 hour")
    return s.select("device_id", "data_type", ntz("interval_start"), ntz("interval_end"),
                    F.col("total").cast("long").alias("total"), F.col("items").cast("long").alias("items"))


@query("batch_by_type")
def q_batch_by_type(spark, sf_dir):
    """Readings per gateway, 30 s flush and type (non-empty groups only)."""
    s = B.batch_by_type(FX.readings(spark, sf_dir))
    return s.select("gateway_id", ntz("flush_start"), "data_type",
                    F.col("items").cast("long").alias("items"), rnd("value_sum").alias("value_sum"))


@query("batch_envelopes")
def q_batch_envelopes(spark, sf_dir):
    """A2: the batch itself, one JSON text per gateway and flush interval."""
    b = B.batch_envelopes(FX.readings(spark, sf_dir))
    return b.select(F.col(GATEWAY_FIELD).alias("gateway_id"), ntz("flush_start"), F.to_json(DATA_FIELD).alias("payload"))


@query("slim_items")
def q_slim_items(spark, sf_dir):
    """The slim item of each reading, as forwarded."""
    return B.slim_items(FX.readings(spark, sf_dir)).select("seq", F.to_json("item").alias("item"))


@query("tag_reading")
def q_tag_reading(spark, sf_dir):
    """Typed readings with their source time, or the arrival time where it has none
    (here: the latest time of the table)."""
    r = FX.readings_with_gaps(spark, sf_dir)
    t = B.tag_reading(r, _now(FX.readings(spark, sf_dir)))
    return t.select("seq", "data_type", "value", "device_id", ntz("ts"))


@query("rolling_metrics_gaps")
def q_rolling_metrics_gaps(spark, sf_dir):
    """W1-W3 where ids, types or times are missing: every reading keeps its row."""
    m = M.rolling_metrics(FX.readings_with_gaps(spark, sf_dir))
    return m.select("device_id", "data_type", "seq", F.col("history_size").cast("long").alias("history_size"),
                    rnd("average_value").alias("average_value"), rnd("variance").alias("variance"))


@query("validate_gaps")
def q_validate_gaps(spark, sf_dir):
    """W7, W10 where ids, types or times are missing."""
    v = V.validate_readings(FX.readings_with_gaps(spark, sf_dir), rules=FX.FIXTURE_RULES)
    h = M.last_n_history(FX.readings_with_gaps(spark, sf_dir)).select("seq", "recency_rank")
    v = v.select("seq", F.col("history_size").cast("long").alias("history_size"), rnd("history_mean").alias("history_mean"))
    return v.join(h, "seq", "left")


@query("type_counts")
def q_type_counts(spark, sf_dir):
    """A3: readings per type."""
    return B.type_counts(FX.readings(spark, sf_dir)).select(
        "data_type", F.col("readings").cast("long").alias("readings"))


@query("type_sample")
def q_type_sample(spark, sf_dir):
    """First 5 readings per type and how many more there are."""
    s = B.type_sample(FX.readings(spark, sf_dir))
    return s.select("data_type", "seq", "value", "sample_rank", "more")


def _registries(spark, sf_dir):
    r = FX.readings(spark, sf_dir)
    early = r.filter(F.col("ts") < F.to_timestamp(F.lit(FX.REGISTRY_SPLIT)))
    late = r.filter(F.col("ts") >= F.to_timestamp(F.lit(FX.REGISTRY_SPLIT)))
    gw = G.registry_upsert(G.registry_upsert(None, early, ["gateway_id"]), late, ["gateway_id"])
    dv = G.registry_upsert(G.registry_upsert(None, early, ["device_id"]), late, ["device_id"])
    mp = G.mapping_upsert(G.mapping_upsert(None, early), late)
    return r, gw, dv, mp


def _stored_registries(spark, sf_dir):
    """The same, each registry built once and kept as a table."""
    r, *registries = _registries(spark, sf_dir)
    return (r, *(_stored(spark, df, "registry") for df in registries))


def _stored(spark, df, name):
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@query("registry_upsert")
def q_registry_upsert(spark, sf_dir):
    """Gateway and device registries, loaded in two upserts."""
    _, gw, dv, _ = _registries(spark, sf_dir)
    g = gw.select(F.lit("gateway").alias("entity"), F.col("gateway_id").alias("id"), "last_seen", "last_seq")
    d = dv.select(F.lit("device").alias("entity"), F.col("device_id").alias("id"), "last_seen", "last_seq")
    return g.unionByName(d).select("entity", "id", ntz("last_seen"), "last_seq")


@query("mapping_upsert")
def q_mapping_upsert(spark, sf_dir):
    """A10: device-gateway mapping with first and last connection."""
    _, _, _, mp = _registries(spark, sf_dir)
    return mp.select("device_id", "gateway_id", ntz("first_connected"), "first_seq",
                     ntz("last_connected"), "last_seq")


@query("presence")
def q_presence(spark, sf_dir):
    """Current connection state per device (signup = connect, error = disconnect)."""
    p = G.presence(FX.presence_events(spark, sf_dir))
    return p.select("device_id", "state", ntz("since"), "connected")


@query("connected_for")
def q_connected_for(spark, sf_dir):
    """Connected devices at the table's last time, with h/m/s text."""
    r = FX.readings(spark, sf_dir)
    now = r.select(F.max("ts")).scalar()
    c = G.connected_for(G.presence(FX.presence_events(spark, sf_dir)), now)
    return c.select("device_id", ntz("since"), "elapsed_seconds", "elapsed_text")


def _now(r):
    return r.select(F.max("ts")).scalar()


@query("inactive_counts")
def q_inactive_counts(spark, sf_dir):
    """Devices and gateways not seen in the hour before the table's last time."""
    r, gw, dv, _ = _registries(spark, sf_dir)
    c = RT.inactive_counts(dv, gw, _now(r))
    return c.select("entity", F.col("inactive").cast("long").alias("inactive"))


def _retention(spark, sf_dir):
    r, gw, dv, mp = _stored_registries(spark, sf_dir)
    return RT.apply_retention(r, mp, dv, gw, _now(r))


@query("retention")
def q_retention(spark, sf_dir):
    """Measurements that survive the cascaded retention delete."""
    return _retention(spark, sf_dir)["measurements"].select("seq", "device_id", "gateway_id", "data_type")


@query("retention_report")
def q_retention_report(spark, sf_dir):
    """Rows removed per table by the retention run."""
    r, gw, dv, mp = _stored_registries(spark, sf_dir)
    rep = RT.retention_report(r, mp, dv, gw, _now(r))
    return rep.select("table_name", *[F.col(c).cast("long").alias(c)
                                      for c in ["before_rows", "after_rows", "removed_rows"]])


@query("retention_delete")
def q_retention_delete(spark, sf_dir):
    """J1, X3 as a write: stored tables, counts first, then only the partitions that hold dead rows
    are rewritten; the rows left are counted again from the tables."""
    r = FX.readings(spark, sf_dir)
    base = scratch_dir(spark, "retention-delete")
    at = TS.Registries(*[f"{base}/{t}" for t in TS.Registries._fields])
    H.write_measurements(r, at.measurements)
    TS.upsert_registries(r, at, buckets=8)
    plan = TS.plan_retention(spark, at, _now(r))
    TS.execute_retention(spark, plan)
    after = H.table_counts(spark, TS.Registries._fields, lambda n: f"{base}/{n}")
    counted = plan.report(spark).select("table_name", "before_rows", "removed_rows")
    return counted.join(after, "table_name").select("table_name", "before_rows", F.col("row_count").alias("after_rows"), "removed_rows")


@query("current_subscriptions")
def q_current_subscriptions(spark, sf_dir):
    """The set after folding the control actions over the default list."""
    return SB.current_subscriptions(FX.control_events(spark, sf_dir), spark, FX.FIXTURE_DEFAULT_SUBSCRIPTIONS)


@query("subscribed_readings")
def q_subscribed_readings(spark, sf_dir):
    """Readings on subscribed topics, as (topic, message)."""
    r = FX.readings(spark, sf_dir)
    s = SB.current_subscriptions(FX.control_events(spark, sf_dir), spark, FX.FIXTURE_DEFAULT_SUBSCRIPTIONS)
    return _published(SB.subscribed_readings(r, s), keep=["seq"])


def _published(readings, keep=()):
    payload = F.to_json(F.struct(F.col("data_type").alias(TYPE_FIELD), F.col("value").cast("long").alias(VALUE_FIELD),
                                 F.col("device_id").alias(ID_FIELD)))
    return SB.publish_messages(readings.withColumn("payload", payload).withColumn("fmt", F.lit("JSON")), "payload", "fmt", keep=keep)


@query("subscription_gate")
def q_subscription_gate(spark, sf_dir):
    """As-of gate -- the last control action of the type at or before the reading."""
    g = SB.subscription_gate(FX.readings(spark, sf_dir), FX.control_events(spark, sf_dir),
                             default=FX.FIXTURE_DEFAULT_SUBSCRIPTIONS)
    return g.select("seq", "data_type", "gate_action", "subscribed")


# --------------------------------------------------------------------------
# Sources: frames, routing, batches, tagged messages, encoders, extraction
# --------------------------------------------------------------------------


def _frames(spark, sf_dir):
    """Frames built from readings: signup -> connect (101, id text), error ->
    disconnect (501), others -> device data (201, one-item device batch); plus
    a 3-byte frame and an unknown code."""
    r = FX.readings(spark, sf_dir)
    code = (F.when(F.col("data_type") == "signup", 101).when(F.col("data_type") == "error", 501)
             .otherwise(201))
    batch = F.to_json(F.struct(F.col("device_id").alias("WavyId"),
                               F.array(F.struct(F.col("data_type").alias("DataType"),
                                                F.col("value").cast("long").alias("Value"))).alias("Data")))
    payload = F.when(code == 201, batch).otherwise(F.col("device_id"))
    f = r.select("seq", EN.encode_frame(code, payload).alias("frame"))
    extra = spark.createDataFrame([(-1, bytes([1, 2, 3])), (-2, bytes([0xE7, 3, 0, 0]) + b"x"),
                                   (-3, bytes([101, 0, 0, 0]) + b"a\xffb")],
                                  "seq long, frame binary")
    return f.unionByName(extra)


@query("decode_frames")
def q_decode_frames(spark, sf_dir):
    """Code and payload of each frame; short frames rejected."""
    d = D.decode_frames(_frames(spark, sf_dir))
    return d.select("seq", F.col("code").cast("long").alias("code"), "payload", "reject_reason")


@query("route_messages")
def q_route_messages(spark, sf_dir):
    """Message kind by code; unknown codes and malformed frames go to
    the dead letters with a reason."""
    d = D.route_messages(D.decode_frames(_frames(spark, sf_dir)))
    return d.select("seq", "kind", "reject_reason")


def _batch_id():
    return F.floor(F.col("seq") / FX.BATCH_SIZE).cast("long").alias("batch_id")


@query("parse_device_batch")
def q_parse_device_batch(spark, sf_dir):
    """Device batches (one per batch and device) decoded back to
    items; batches and items that are not accepted come out with a reason."""
    r = FX.readings(spark, sf_dir).withColumn("batch_id", _batch_id())
    b = EN.device_batches(r, ["batch_id"]).select("batch_id", "payload")
    own = f'"{ID_FIELD}":"x"'
    item = f'"{TYPE_FIELD}":"view"'
    bad = spark.createDataFrame([
        (-1, f'{{"{DATA_FIELD}":[{{{item},"{VALUE_FIELD}":1}}]}}'),
        (-2, f'{{{own},"{DATA_FIELD}":{{}}}}'),
        (-3, f'{{{own},"{DATA_FIELD}":[{{"{VALUE_FIELD}":1}},{{{item}}},{{{item},"{VALUE_FIELD}":"7"}},{{"{TYPE_FIELD}":5}}]}}'),
        (-4, "garbage"), (-5, None), (-6, f'{{{own},"{DATA_FIELD}":[]}}')], "batch_id long, payload string")
    p = D.parse_device_batch(b.unionByName(bad))
    return p.select("batch_id", "device_id", "data_type", "value", "reject_reason")


@query("parse_optional_batch")
def q_parse_optional_batch(spark, sf_dir):
    """Batches whose id may be absent (every fifth batch); each item
    keeps its properties, with the batch id in place of its own if there is one."""
    r = FX.readings(spark, sf_dir).withColumn("batch_id", _batch_id())
    item = F.struct(F.col("seq").alias("_o"), F.col("data_type").alias(TYPE_FIELD),
                    F.col("value").alias(VALUE_FIELD), F.lit("item-own").alias(ID_FIELD))
    g = r.groupBy("batch_id", "device_id").agg(F.array_sort(F.collect_list(item)).alias("_i"))
    data = F.transform("_i", lambda x: F.struct(*[x[n].alias(n) for n in (TYPE_FIELD, VALUE_FIELD, ID_FIELD)])).alias(DATA_FIELD)
    payload = F.when(F.col("batch_id") % 5 == 0, F.to_json(F.struct(data))).otherwise(
        F.to_json(F.struct(F.col("device_id").alias(ID_FIELD), data)))
    bad = spark.createDataFrame([
        (-1, f'{{"{DATA_FIELD}":[{{"{VALUE_FIELD}":1}}]}}'),
        (-2, f'{{"{ID_FIELD}":"x","{DATA_FIELD}":[{{"{TYPE_FIELD}":"view","{VALUE_FIELD}":"z"}}]}}'),
        (-3, "garbage"), (-4, f'{{"{DATA_FIELD}":[{{"{TYPE_FIELD}":"view"}}]}}')], "batch_id long, payload string")
    p = D.parse_optional_batch(g.select("batch_id", payload.alias("payload")).unionByName(bad))
    return p.select("batch_id", F.col("item").getItem(ID_FIELD).alias("device_id"), "data_type",
                    F.col("item").getItem(VALUE_FIELD).try_cast("double").alias("value"), "reject_reason")


@query("parse_gateway_batch")
def q_parse_gateway_batch(spark, sf_dir):
    """Gateway envelopes (inner data as arrays, as JSON text of a
    single item, items as JSON text) decoded to measurements; bad groups and
    items are kept as rejects with a reason."""
    r = FX.readings(spark, sf_dir).withColumn("batch_id", _batch_id())
    g = EN.gateway_batches(r, ["batch_id"], text_items=(F.col("seq") % 2 == 1))
    bad = spark.createDataFrame([
        (-1, '{"AggregatorId":"9","Timestamp":"2024-01-01T00:00:00Z","Data":[{"DataType":"view"}]}'),
        (-2, '{"AggregatorId":"9","Timestamp":"2024-01-01T00:00:00Z","Data":[{"DataType":"view","Data":[5,'
             '{"Value":"x","value":1,"WavyId":"d"},{"wavyId":"","Value":"2.5"}]}]}'),
        (-3, "garbage"),
        (-4, f'{{"{GATEWAY_FIELD}":"9","{TIME_FIELD}":"yesterday","{DATA_FIELD}":[{{"{TYPE_FIELD}":"view","{DATA_FIELD}":[]}}]}}')],
        "batch_id long, payload string")
    p = D.parse_gateway_batch(g.select("batch_id", "payload").unionByName(bad))
    return p.select("aggregator_id", ntz("batch_time"), "data_type", "device_id", "value", "reject_reason")


def _tagged(spark, sf_dir):
    """Tagged messages from readings: XML (seq % 3 = 0), JSON with prefix
    (1), JSON without prefix (2); plus one undecodable message."""
    r = FX.readings(spark, sf_dir)
    xml = EN.reading_xml("data_type", EN.number_text("value"), "device_id")
    js = EN.reading_json("data_type", "value", "device_id")
    k = F.col("seq") % 3
    msg = F.when(k == 0, EN.tag_message(F.lit("XML"), xml)).when(k == 1, EN.tag_message(F.lit("JSON"), js)) \
        .otherwise(js)
    m = r.select("seq", msg.alias("message"))
    return m.unionByName(spark.createDataFrame([(-1, "JSON:{not json")], "seq long, message string"))


@query("detect_format")
def q_detect_format(spark, sf_dir):
    """Format from the prefix (default JSON) and the content after it."""
    d = D.detect_format(_tagged(spark, sf_dir))
    return d.select("seq", "format", "content")


@query("decode_xml")
def q_decode_xml(spark, sf_dir):
    """XML messages decoded (attributes + child elements) to readings."""
    d = D.decode_tagged(_tagged(spark, sf_dir)).filter(F.col("format") == "XML")
    good, _ = D.split_rejects(D.reading_from_fields(d))
    return good.select("seq", "device_id", "data_type", "value")


@query("decode_xml_general")
def q_decode_xml_general(spark, sf_dir):
    """Flat XML with any fields: attributes quoted either way, children with
    CDATA, repeated names (the last wins), empty roots, no root."""
    r = FX.readings(spark, sf_dir)
    v = EN.number_text("value")
    k = F.col("seq") % 4
    msg = (F.when(k == 0, F.concat(F.lit("<S a='1 &amp; \"2\"' id='"), "device_id", F.lit("'><v>"), v, F.lit("</v><u><![CDATA[<m&]]></u></S>")))
            .when(k == 1, F.concat(F.lit('<?xml version="1.0"?>\n<S id="'), "device_id", F.lit('" u="x">\n <v> 0</v><v>'), v, F.lit("</v>\n</S>")))
            .when(k == 2, F.lit("<a></a>")).otherwise(F.lit("no root")))
    m = r.select("seq", D.xml_to_map(msg).alias("m"))
    return m.select("seq", F.when(F.col("m").isNotNull(), F.size("m")).cast("long").alias("fields"), F.col("m")["id"].alias("device_id"),
                    F.col("m")["a"].alias("a"), F.col("m")["u"].alias("unit"), F.col("m")["v"].try_cast("double").alias("value"))


@query("decode_json")
def q_decode_json(spark, sf_dir):
    """JSON messages decoded to readings (the malformed one goes to
    the dead letters); the events' own ``props`` JSON decoded the same way."""
    d = D.decode_tagged(_tagged(spark, sf_dir)).filter(F.col("format") == "JSON")
    good, _ = D.split_rejects(D.reading_from_fields(d))
    props = FX.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), D.json_to_map("props").getItem("k").cast("long").alias("k"))
    return good.select("seq", "device_id", "data_type", "value").join(props, "seq", "left")


@query("encode_json")
def q_encode_json(spark, sf_dir):
    """The JSON text of each reading."""
    r = FX.readings(spark, sf_dir)
    return r.select("seq", EN.reading_json("data_type", "value", "device_id").alias("payload"))


@query("encode_xml")
def q_encode_xml(spark, sf_dir):
    """The XML document of each reading (id as attribute)."""
    r = FX.readings(spark, sf_dir)
    return r.select("seq", EN.reading_xml("data_type", EN.number_text("value"), "device_id").alias("payload"))


def _items(spark, sf_dir):
    """Measurement items in six shapes, chosen by seq % 6."""
    r = FX.readings(spark, sf_dir)
    v = F.col("value").cast("string")
    dev = EN.json_string("device_id")
    k = F.col("seq") % 6
    text = (F.when(k == 0, F.concat(F.lit('{"WavyId":'), dev, F.lit(',"Value":'), v, F.lit("}")))
             .when(k == 1, F.concat(F.lit('{"wavyId":'), dev, F.lit(',"Value":"'), v, F.lit('"}')))
             .when(k == 2, F.concat(F.lit('{"WavyId":"","value":'), v, F.lit("}")))
             .when(k == 3, F.concat(F.lit('{"WavyId":'), dev, F.lit(',"Value":"x","value":'), v, F.lit("}")))
             .when(k == 4, F.lit('{"Value":null}'))
             .otherwise(F.concat(F.lit('{"WavyId":7,"Value":'), v, F.lit("}"))))
    return r.select("seq", F.try_parse_json(text).alias("item"))


@query("extract_strict")
def q_extract_strict(spark, sf_dir):
    """Server-side id and strict value extraction (bad value -> rejected)."""
    i = _items(spark, sf_dir)
    return i.select("seq", D.device_id_of(F.col("item")).alias("device_id"),
                    D.strict_value_of(F.col("item")).alias("value"))


@query("extract_lenient")
def q_extract_lenient(spark, sf_dir):
    """Gateway-side lenient extraction (bad or missing value -> 0.0; a
    non-text id makes the item unreadable)."""
    i = _items(spark, sf_dir)
    return i.select("seq", D.lenient_device_of(F.col("item")).alias("device_id"),
                    D.lenient_value_of(F.col("item")).alias("value"))


# --------------------------------------------------------------------------
# Tables: counts, ranged history, resends
# --------------------------------------------------------------------------


GIVEN_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("table_counts")
def q_table_counts(spark, sf_dir):
    """A4: rows per table; a table that does not exist reports -1."""
    names = GIVEN_TABLES + ["measurements"]
    c = H.table_counts(spark, names, lambda n: f"{sf_dir.rstrip('/')}/{n}.parquet")
    return c.select("table_name", F.col("row_count").cast("long").alias("row_count"))


@query("history_range")
def q_history_range(spark, sf_dir):
    """Measurements written as a table partitioned by type and
    day, read back for one device and a ten-day range (partition pruning and
    pushed filters), with the epoch-millisecond wire time."""
    path = scratch_dir(spark, "measurements")
    H.write_measurements(FX.readings(spark, sf_dir), path, mode="overwrite")
    h = H.read_history(spark, path, "3", "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    h = H.with_epoch_millis(h)
    return h.select("seq", "device_id", "data_type", "value", "ts_ms", ntz("ts_roundtrip"))


@query("resend_dedupe")
def q_resend_dedupe(spark, sf_dir):
    """Device batches sent with code 201, every fourth batch resent with
    202 (same payload); one row per distinct batch with its copies."""
    r = FX.readings(spark, sf_dir).withColumn("batch_id", _batch_id())
    b = EN.device_batches(r, ["batch_id"])
    sends = b.select("batch_id", "device_id", "payload", F.lit(201).alias("code"), F.lit(0).alias("seq"))
    resends = (b.filter(F.col("batch_id") % 4 == 0)
                .select("batch_id", "device_id", "payload", F.lit(202).alias("code"), F.lit(1).alias("seq")))
    d = H.dedupe_resends(sends.unionByName(resends), key_cols=["batch_id", "device_id"])
    return d.select("batch_id", "device_id", F.col("copies").cast("long").alias("copies"),
                    F.col("code").cast("long").alias("kept_code"))


# --------------------------------------------------------------------------
# Streaming twins: the readings arrive in parts, the stream runs with
# availableNow after each, and what it wrote is returned (a batch DataFrame)
# --------------------------------------------------------------------------


def _in_parts(df, base, *starts, parts=None):
    """The rows arrive in two parts, in time order; the streams stop and go on in between."""
    SR.run_in_parts(parts or SR.split_by_time(df, [FX.REGISTRY_SPLIT]), f"{base}/source", *starts)


def _run_to_parquet(spark, df, name, transform):
    base = scratch_dir(spark, name)
    _in_parts(df, base, lambda s: SR.to_parquet(transform(s), f"{base}/out", f"{base}/checkpoint")())
    return spark.read.parquet(f"{base}/out")


def _written(spark, base, name):
    """All rows of a table that a finished stream wrote."""
    schema = spark.read.parquet(f"{base}/tables/{name}").drop("stream_batch").schema
    return SC.read_committed(spark, f"{base}/tables", name, schema)


def _run_window_sums(spark, df, name, sums, parts=None):
    base = scratch_dir(spark, name)
    _in_parts(df, base, lambda s: SW.start_window_sums(s, sums, f"{base}/tables", f"{base}/checkpoint"), parts=parts)
    return SW.window_sums(spark, f"{base}/tables", sums)


@query("stream_presence")
def q_stream_presence(spark, sf_dir):
    """The current connection state per device, kept by a stream."""
    base = scratch_dir(spark, "stream-presence")
    _in_parts(FX.presence_events(spark, sf_dir), base, lambda s: SW.start_presence(s, f"{base}/tables", f"{base}/checkpoint"))
    SW.fold_presence(spark, f"{base}/tables")
    out = SW.current_presence(spark, f"{base}/tables")
    return out.select("device_id", "state", ntz("since"), "connected")


@query("stream_flush")
def q_stream_flush(spark, sf_dir):
    """30 s gateway flush on a stream; equals the batch result."""
    out = _run_window_sums(spark, FX.readings(spark, sf_dir), "stream-flush", SW.flush_sums())
    return out.select("gateway_id", ntz("flush_start"), "data_type",
                      F.col("items").cast("long").alias("items"), rnd("value_sum").alias("value_sum"))


@query("stream_interval_sum")
def q_stream_interval_sum(spark, sf_dir):
    """Interval sums on a stream (1 hour on this sparse table)."""
    out = _run_window_sums(spark, FX.readings(spark, sf_dir), "stream-interval", SW.interval_sums("1 hour"))
    return out.select("device_id", "data_type", ntz("interval_start"), ntz("interval_end"),
                      F.col("total").cast("long").alias("total"), F.col("items").cast("long").alias("items"))


@query("stream_late")
def q_stream_late(spark, sf_dir):
    """T2 where every seventh reading comes after all others: nothing is lost, and the items whose
    interval had ended are told apart."""
    r = FX.readings(spark, sf_dir)
    parts = [r.filter(F.col("seq") % 7 != 0), r.filter(F.col("seq") % 7 == 0)]
    out = _run_window_sums(spark, r, "stream-late", SW.interval_sums("1 hour"), parts)
    return out.select("device_id", "data_type", ntz("interval_start"), ntz("interval_end"), F.col("total").cast("long").alias("total"),
                      F.col("items").cast("long").alias("items"), F.col("late_items").cast("long").alias("late_items"))


@query("stream_envelopes")
def q_stream_envelopes(spark, sf_dir):
    """Every 30 s flush window of a gateway leaves the stream once, as one envelope; the windows open at the
    end are flushed by a marker."""
    r = FX.readings(spark, sf_dir).withColumn("marker", F.lit(False))
    r = r.unionByName(SE.flush_marker(spark, r.schema, r.agg(F.max("ts")).first()[0]))
    out = _run_to_parquet(spark, r, "stream-envelopes",
                          lambda s: SE.stream_envelopes(s).withColumn("payload", F.to_json(DATA_FIELD)).drop(DATA_FIELD))
    return out.select(F.col(GATEWAY_FIELD).alias("gateway_id"), ntz("flush_start"), "payload")


@query("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    """Gateway envelopes decoded once, then measurements, metrics and registries of a micro-batch under one
    commit; here the measurements with their metrics."""
    base = scratch_dir(spark, "stream-ingest")
    r = FX.readings(spark, sf_dir).withColumn("batch_id", _batch_id())
    g = EN.gateway_batches(r, ["batch_id"], text_items=(F.col("seq") % 2 == 1))
    envelopes = g.select((F.col("batch_id") * FX.GATEWAYS + F.col("gateway_id").cast("long")).alias("envelope_id"), "payload",
                         F.col("batch_time").alias("ts"), F.col("batch_id").alias("seq"))
    _in_parts(envelopes, base, lambda s: SI.start_decoding(s, f"{base}/items", f"{base}/checkpoint-items"),
              lambda _: SI.start_ingest(SR.read_landing(spark, f"{base}/items", SI.ITEM), f"{base}/tables", f"{base}/checkpoint"))
    m = _written(spark, base, SI.MEASUREMENTS).select("envelope_id", "device_id", "gateway_id", "data_type", "value", "seq")
    c = _written(spark, base, SI.METRICS).select("device_id", "data_type", "seq", "history_size", "average_value")
    joined = m.join(c, ["device_id", "data_type", "seq"], "left")
    return joined.select("envelope_id", "device_id", "gateway_id", "data_type", "value", F.col("history_size").cast("long").alias("history_size"),
                         rnd("average_value").alias("average_value"))


@query("stream_publish")
def q_stream_publish(spark, sf_dir):
    """Messages of subscribed readings on a stream, written once each into a folder per topic."""
    base = scratch_dir(spark, "stream-publish")
    subs = SB.current_subscriptions(FX.control_events(spark, sf_dir), spark, FX.FIXTURE_DEFAULT_SUBSCRIPTIONS)
    _in_parts(FX.readings(spark, sf_dir), base,
              lambda s: SB.start_topic_sink(_published(SS.gate_stream(s, subs)), f"{base}/topics", f"{base}/checkpoint"))
    return spark.read.text(f"{base}/topics").select("topic", F.col("value").alias("message"))


@query("stream_upsert")
def q_stream_upsert(spark, sf_dir):
    """The registries as stored tables, upserted micro-batch by micro-batch."""
    base = scratch_dir(spark, "stream-upsert")
    at = TS.Registries(*[f"{base}/{t}" for t in TS.Registries._fields])
    _in_parts(FX.readings(spark, sf_dir), base, lambda s: TS.start_registry_stream(s, at, f"{base}/checkpoint", buckets=8))
    g = TS.read_stored(spark, at.gateways).select(F.lit("gateway").alias("entity"), F.col("gateway_id").alias("id"), "last_seen", "last_seq")
    d = TS.read_stored(spark, at.devices).select(F.lit("device").alias("entity"), F.col("device_id").alias("id"), "last_seen", "last_seq")
    return g.unionByName(d).select("entity", "id", ntz("last_seen"), "last_seq")


@query("stored_mapping")
def q_stored_mapping(spark, sf_dir):
    """A10: the device-gateway mapping as a stored table, from two loads."""
    r, base = FX.readings(spark, sf_dir), scratch_dir(spark, "stored-mapping")
    split = F.to_timestamp(F.lit(FX.REGISTRY_SPLIT))
    for part in (r.filter(F.col("ts") < split), r.filter(F.col("ts") >= split)):
        TS.upsert(f"{base}/mappings", part, ["device_id", "gateway_id"], TS.merge_mapping, buckets=8)
    mp = TS.read_stored(spark, f"{base}/mappings")
    return mp.select("device_id", "gateway_id", ntz("first_connected"), "first_seq", ntz("last_connected"), "last_seq")


@query("stream_metrics")
def q_stream_metrics(spark, sf_dir):
    """Rolling metrics with bounded keyed state (last 100 values)."""
    out = _run_to_parquet(spark, FX.readings(spark, sf_dir), "stream-metrics", ST.stream_rolling_metrics)
    return out.select("device_id", "data_type", "seq", ntz("ts"), "original_value",
                      F.col("history_size").cast("long").alias("history_size"),
                      *[rnd(c).alias(c) for c in M.METRIC_COLUMNS])


@query("stream_validate")
def q_stream_validate(spark, sf_dir):
    """T4: validation with the valid-only history and non-finite replacement
    on a stream, micro-batch by micro-batch; equals the batch result."""
    base = scratch_dir(spark, "stream-validate")
    _in_parts(FX.readings(spark, sf_dir, with_nan=True), base,
              lambda s: TL.start_validation_stream(s, f"{base}/tables", f"{base}/checkpoint", rules=FX.FIXTURE_RULES))
    v = _written(spark, base, TL.VALIDATED)
    return v.select("device_id", "data_type", "seq", "original_value",
                    rnd("cleaned_value").alias("cleaned_value"), "was_modified",
                    "validation_message", rnd("type_average").alias("type_average"))


@query("stream_type_average")
def q_stream_type_average(spark, sf_dir):
    """T5: the per-type average over the histories that the stream's state holds at the end."""
    base = scratch_dir(spark, "stream-pools")
    _in_parts(FX.readings(spark, sf_dir, with_nan=True), base,
              lambda s: TL.start_pool_stream(s, f"{base}/tables", f"{base}/checkpoint", rules=FX.FIXTURE_RULES))
    a = TL.pool_averages(spark, f"{base}/tables")
    return a.select("data_type", F.col("pool_values").cast("long").alias("pool_values"),
                    rnd("pool_sum").alias("pool_sum"), rnd("type_average").alias("type_average"))


@query("stream_gate")
def q_stream_gate(spark, sf_dir):
    """Readings on subscribed types, stream-static semi join."""
    subs = SB.current_subscriptions(FX.control_events(spark, sf_dir), spark, FX.FIXTURE_DEFAULT_SUBSCRIPTIONS)
    out = _run_to_parquet(spark, FX.readings(spark, sf_dir), "stream-gate",
                          lambda s: SS.gate_stream(s, subs).select("seq", "data_type", "device_id"))
    return out.select("seq", "data_type", "device_id")


@query("stream_inactivity")
def q_stream_inactivity(spark, sf_dir):
    """Inactivity periods (1 h) from an event-time timer per device."""
    out = _run_to_parquet(spark, FX.readings(spark, sf_dir), "stream-inactivity", ST.stream_inactivity)
    return out.select("device_id", ntz("inactive_since"))


@query("stream_atomic_write")
def q_stream_atomic_write(spark, sf_dir):
    """Device batches (every fourth one resent) streamed,
    de-duplicated within the watermark, decoded and written one micro-batch
    per partition; the measurements are read back."""
    base = scratch_dir(spark, "stream-atomic")
    r = FX.readings(spark, sf_dir).withColumn("envelope_id", F.floor(F.col("seq") / FX.BATCH_SIZE).cast("long"))
    b = EN.device_batches(r, ["envelope_id"]).join(
        r.groupBy("envelope_id", "device_id").agg(F.max("ts").alias("ts"), F.max("seq").alias("seq")),
        ["envelope_id", "device_id"])
    sends = b.withColumn("code", F.lit(201)).unionByName(
        b.filter(F.col("envelope_id") % 4 == 0).withColumn("code", F.lit(202)))

    def decode(df):
        items, _ = D.split_rejects(D.parse_device_batch(df.select("envelope_id", "payload", "batch_time")))
        return items.withColumnRenamed("batch_time", "ts").select("envelope_id", "device_id", "data_type",
                                                                  "value", "ts")

    def start(s):
        d = SS.dedupe_stream(s.withColumnRenamed("ts", "batch_time"), ["envelope_id", "device_id"])
        return SS.start_batch_writer(d, f"{base}/out", f"{base}/checkpoint", decode)

    _in_parts(sends, base, start)
    m = spark.read.parquet(f"{base}/out")
    return m.select(F.col("envelope_id").alias("batch_id"), "device_id", "data_type", "value")


@query("metrics_table")
def q_metrics_table(spark, sf_dir):
    """Calculated metrics appended to a table partitioned by type and
    day, read back whole."""
    path = scratch_dir(spark, "metrics")
    H.write_metrics(M.rolling_metrics(FX.readings(spark, sf_dir)), path, mode="overwrite")
    m = spark.read.parquet(path)
    return m.select("device_id", "data_type", "seq", ntz("ts"), F.col("value").alias("original_value"),
                    F.col("history_size").cast("long").alias("history_size"),
                    *[rnd(c).alias(c) for c in M.METRIC_COLUMNS])


@query("subscription_file")
def q_subscription_file(spark, sf_dir):
    """The subscription list file -- the default list while no file
    exists, then the saved current set read back."""
    path = scratch_dir(spark, "subscriptions")
    first = SB.load_subscriptions(spark, path, FX.FIXTURE_DEFAULT_SUBSCRIPTIONS)
    cur = SB.current_subscriptions(FX.control_events(spark, sf_dir), spark, FX.FIXTURE_DEFAULT_SUBSCRIPTIONS)
    SB.save_subscriptions(cur, path)
    saved = SB.load_subscriptions(spark, path, FX.FIXTURE_DEFAULT_SUBSCRIPTIONS)
    return (first.select(F.lit("default").alias("stage"), "data_type")
                 .unionByName(saved.select(F.lit("saved").alias("stage"), "data_type")))


@query("topic_prefix_gate")
def q_topic_prefix_gate(spark, sf_dir):
    """socket-style topic matching -- a subscription matches every topic
    it is a prefix of.  Topics: the first letter of each subscribed type plus
    the prefix "v"."""
    r = FX.readings(spark, sf_dir)
    cur = SB.current_subscriptions(FX.control_events(spark, sf_dir), spark, FX.FIXTURE_DEFAULT_SUBSCRIPTIONS)
    topics = cur.select(F.substring("data_type", 1, 1).alias("data_type")).unionByName(
        spark.createDataFrame([("v",)], "data_type string"))
    return SB.subscribed_readings(r, topics, prefix=True).select("seq", "data_type")


@query("stream_metrics_batched")
def q_stream_metrics_batched(spark, sf_dir):
    """T3 without per-key grouping of readings: each micro-batch runs the skew-safe batch
    plan over its rows plus the last 99 values of the keys it touches."""
    base = scratch_dir(spark, "stream-metrics-batched")
    _in_parts(FX.readings(spark, sf_dir), base, lambda s: TL.start_metrics_stream(s, f"{base}/tables", f"{base}/checkpoint"))
    out = _written(spark, base, TL.METRICS)
    return out.select("device_id", "data_type", "seq", ntz("ts"), F.col("value").alias("original_value"),
                      F.col("history_size").cast("long").alias("history_size"),
                      *[rnd(c).alias(c) for c in M.METRIC_COLUMNS])
