"""Views over the given tables that the query catalogue runs on.

``readings``: one sensor reading per ``events`` row.  ``device_id`` folds users
into 10 devices so that keys carry a few hundred readings (the 100-reading
history then fills and evicts); ``gateway_id`` spreads each device over three
gateways; ``value`` may be turned into NaN on a fixed rule for the cleaning
queries (the table itself has no non-finite values).  All rows are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixture range rules on the events types: (data_type, min, max); "click" has
# no rule and takes the unbounded default branch.
FIXTURE_RULES = [
    ("signup", 1.0, 150.0),
    ("purchase", 1.0, 150.0),
    ("error", 0.0, 150.0),
    ("view", 0.0, 140.0),
]
NAN_EVERY = 97        # value is NaN where event_id % 97 = 0 in cleaning queries
BATCH_SIZE = 8        # envelope batch = event_id div 8
DEVICES = 10
GATEWAYS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str, with_nan: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "events")
    value = F.col("value")
    if with_nan:
        value = F.when(F.col("event_id") % NAN_EVERY == 0, F.lit(float("nan"))).otherwise(value)
    return e.select(
        (F.col("user_id") % DEVICES).cast("string").alias("device_id"),
        (F.col("event_id") % GATEWAYS).cast("string").alias("gateway_id"),
        F.col("event_type").alias("data_type"),
        value.cast("double").alias("value"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


def fixture_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXTURE_RULES, "data_type string, min_value double, max_value double")


# Control actions come from the sign-ups (subscribe) and errors (unsubscribe) of the
# table, each for the type that the user picks; the default set is ["signup"].
CONTROL_TYPES = ["click", "view", "purchase", "signup", "error"]
FIXTURE_DEFAULT_SUBSCRIPTIONS = ["signup"]
# Registries are built in two loads: rows before this time, then the rest.
REGISTRY_SPLIT = "2024-01-16 00:00:00"


def control_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "error"))
    picked = F.element_at(F.array(*[F.lit(t) for t in CONTROL_TYPES]), (F.col("user_id") % len(CONTROL_TYPES) + 1).cast("int"))
    action = F.when(F.col("event_type") == "signup", "subscribe").otherwise("unsubscribe")
    return e.select(picked.alias("data_type"), F.col("ts").cast("timestamp").alias("ts"),
                    F.col("event_id").alias("seq"), action.alias("action"))


def readings_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of which some have no device, no type or no time."""
    r = readings(spark, sf_dir)

    def gap(column: str, every: int):
        return F.when(F.col("seq") % every != 0, F.col(column)).alias(column)

    return r.select(gap("device_id", 11), "gateway_id", gap("data_type", 17), "value", gap("ts", 13), "seq")


def presence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signup = connect, error = disconnect, per device."""
    r = readings(spark, sf_dir)
    kind = F.when(F.col("data_type") == "signup", "connect").when(F.col("data_type") == "error", "disconnect")
    return r.withColumn("kind", kind).filter(F.col("kind").isNotNull())
