"""Subscription sets and gates.

Control events are ``(data_type, ts, seq, action)`` with action ``subscribe``
or ``unsubscribe``; the set starts from a default list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.schema import DEFAULT_SUBSCRIPTIONS

SUBSCRIBE = "subscribe"


def default_subscriptions(spark: SparkSession, types: Sequence[str] = DEFAULT_SUBSCRIPTIONS) -> DataFrame:
    return spark.createDataFrame([(t,) for t in types], "data_type string")


def load_subscriptions(spark: SparkSession, path: str,
                       default: Sequence[str] = DEFAULT_SUBSCRIPTIONS) -> DataFrame:
    """A JSON array of type names in a text file; the default list when
    the file does not exist."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return default_subscriptions(spark, default)
    txt = spark.read.text(path, wholetext=True)
    return (txt.select(F.explode(F.from_json("value", "array<string>")).alias("data_type"))
               .distinct())


def save_subscriptions(subs: DataFrame, path: str) -> None:
    """Write the set as one JSON array (the set is one entry per type)."""
    (subs.agg(F.to_json(F.array_sort(F.collect_set("data_type"))).alias("value"))
         .coalesce(1).write.mode("overwrite").text(path))


def current_subscriptions(control: DataFrame, spark: SparkSession | None = None,
                          default: Sequence[str] = DEFAULT_SUBSCRIPTIONS,
                          type_col: str = "data_type") -> DataFrame:
    """Fold add/remove actions into the current set: the last action per
    type wins; types never acted on keep their default membership."""
    spark = spark or control.sparkSession
    last = control.groupBy(type_col).agg(
        F.max_by("action", F.struct("ts", "seq")).alias("last_action"))
    base = (default_subscriptions(spark, default).withColumnRenamed("data_type", type_col)
            .withColumn("_default", F.lit(True)))
    merged = base.join(last, type_col, "full_outer")
    member = F.coalesce(F.col("last_action") == F.lit(SUBSCRIBE), F.col("_default"), F.lit(False))
    return merged.filter(member).select(type_col)


def subscribed_readings(readings: DataFrame, subs: DataFrame, type_col: str = "data_type",
                        prefix: bool = False) -> DataFrame:
    """Readings whose type is in the set.  ``prefix=True`` gives the
    pub/sub socket rule (a subscription matches every topic it prefixes): the
    distinct types are matched by their prefixes first, then the readings by
    type, so every reading of a matching type passes, once."""
    s = subs.select(F.col(type_col).alias("_topic")).distinct()
    if prefix:
        t = F.col("_type")
        prefixes = F.transform(F.sequence(F.lit(0), F.length(t)), lambda i: F.substring(t, 1, i))
        types = readings.select(F.col(type_col).alias("_type")).distinct().withColumn("_pfx", F.explode(prefixes))
        s = types.join(s, F.col("_pfx") == F.col("_topic"), "left_semi").select(F.col("_type").alias("_topic")).distinct()
    return readings.join(s, F.col(type_col) == F.col("_topic"), "left_semi")


def publish_messages(readings: DataFrame, payload_col: str, fmt_col: str,
                     type_col: str = "data_type", keep: Sequence[str] = ()) -> DataFrame:
    """``(topic, message)`` with the format tag in front of the payload."""
    return readings.select(*keep, F.col(type_col).alias("topic"),
                           F.concat(F.col(fmt_col), F.lit(":"), F.col(payload_col)).alias("message"))


# Actions whose pieces (see ``subscription_gate``) are sent to every task, and time buckets they are cut at.
BROADCAST_ACTIONS = 100_000
GATE_BUCKETS = 1000


def action_spans(control: DataFrame, type_col: str = "data_type", time_col: str = "ts") -> DataFrame:
    """Actions folded to ``type, from_ts, to_ts, action``: each holds until the next one of its type
    (of actions at one time the last by ``seq``); the last one has no end.  NULL times come first."""
    at = F.col(time_col).cast("timestamp")
    last = control.groupBy(F.col(type_col).alias("type"), at.alias("from_ts")).agg(F.max_by("action", "seq").alias("action"))
    order = Window.partitionBy("type").orderBy("from_ts")
    return last.withColumn("to_ts", F.lead("from_ts").over(order)).select("type", "from_ts", "to_ts", "action")


def subscription_gate(readings: DataFrame, control: DataFrame,
                      default: Sequence[str] = DEFAULT_SUBSCRIPTIONS,
                      type_col: str = "data_type", time_col: str = "ts",
                      broadcast_actions: int = BROADCAST_ACTIONS, buckets: int = GATE_BUCKETS) -> DataFrame:
    """A reading passes if the last control action of its type at or
    before it (control first on equal times) is ``subscribe``; with no action
    yet, its default membership decides.  Adds ``gate_action`` and
    ``subscribed``.  A reading without a type matches no subscription: it does
    not pass.  One without a time comes before all actions.

    Actions without a type or a time are left out.

    An interval join: the actions, few against the readings, are folded to spans and cut at the
    edges of equal time buckets over the actions' range, so that a reading looks only at the
    pieces of its own type and bucket.  Up to ``broadcast_actions`` pieces (counted first) they are sent to every task, and the readings are not shuffled; beyond it
    both sides meet by (type, bucket), whose hot ones Spark splits."""
    ctl = control.filter(F.col(type_col).isNotNull() & F.col(time_col).isNotNull())
    micros = F.unix_micros(F.col(time_col).cast("timestamp"))
    size = ctl.agg(F.count(F.lit(1)).alias("n"), F.min(micros).alias("lo"), F.max(micros).alias("hi"),
                   F.count_distinct(type_col).alias("types")).first()
    member = F.coalesce(F.col(type_col).isin(list(default)), F.lit(False)) if default else F.lit(False)
    if not size["n"]:
        return readings.withColumn("gate_action", F.lit(None).cast("string")).withColumn("subscribed", member)
    width = (size["hi"] - size["lo"]) // buckets + 1

    def bucket(us: Column) -> Column:
        # one bucket before the first action, the last one is open
        return F.greatest(F.lit(-1), F.least(F.lit(buckets - 1), F.floor((us - F.lit(size["lo"])) / F.lit(width)))).cast("int")

    spans = action_spans(ctl, type_col, time_col)
    begin, end = F.unix_micros("from_ts"), F.unix_micros("to_ts")
    pieces = spans.select(
        F.col("type").alias("_type"), begin.alias("_from"), end.alias("_to"), F.col("action").alias("gate_action"),
        F.explode(F.sequence(bucket(begin), F.coalesce(bucket(end - 1), F.lit(buckets - 1)))).alias("_bucket"))
    if size["n"] + size["types"] * buckets <= broadcast_actions:       # a piece begins at an action or at an edge
        pieces = F.broadcast(pieces)
    us = F.unix_micros(F.col(time_col).cast("timestamp"))
    held = (F.col(type_col) == F.col("_type")) & (bucket(us) == F.col("_bucket")) & (us >= F.col("_from")) & (
        F.col("_to").isNull() | (us < F.col("_to")))
    out = readings.join(pieces, held, "left").drop("_type", "_from", "_to", "_bucket")
    return out.withColumn("subscribed", F.coalesce(F.col("gate_action") == F.lit(SUBSCRIBE), member))

def write_topics(messages: DataFrame, path: str, mode: str = "append") -> None:
    """S12 sink: ``(topic, message)`` rows written as text files, one folder
    per topic (a Kafka sink takes the same two columns as key/value)."""
    messages.select("topic", F.col("message").alias("value")).write.mode(mode).partitionBy("topic").text(path)


def start_topic_sink(messages: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """S12 on a stream: ``(topic, message)`` as text files, one folder per topic, each message
    once (Spark's file sink commits a micro-batch as a whole; readers of ``path`` see committed files only)."""
    w = (messages.select("topic", F.col("message").alias("value")).writeStream.format("text").partitionBy("topic")
         .option("path", path).option("checkpointLocation", checkpoint))
    return (w.trigger(availableNow=True) if available_now else w).start()
