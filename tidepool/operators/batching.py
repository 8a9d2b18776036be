"""Interval sums, per-type batches, type counts and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.plans.windows import first_k_per_key
from tidepool.schema import ID_FIELD, TYPE_FIELD, VALUE_FIELD, DATA_FIELD, GATEWAY_FIELD, DEVICE_INTERVAL, GATEWAY_FLUSH, UNKNOWN_ID


def interval_sum(df: DataFrame, interval: str = DEVICE_INTERVAL,
                 keys: Sequence[str] = ("device_id", "data_type"),
                 value: str = "value", time_col: str = "ts") -> DataFrame:
    """A1 + P4: per device, type and tumbling interval, the sum of the values
    truncated to integers (the device sends one summed item per type).  A value
    that is no integer after truncation (NaN, infinite, out of range) counts as
    an item and adds nothing."""
    w = F.window(F.col(time_col).cast("timestamp"), interval)
    return (df.groupBy(*keys, w.alias("interval"))
              .agg(F.coalesce(F.sum(F.col(value).try_cast("long")), F.lit(0)).alias("total"),
                   F.count(F.lit(1)).alias("items"))
              .select(*keys, F.col("interval.start").alias("interval_start"),
                      F.col("interval.end").alias("interval_end"), "total", "items"))


def batch_by_type(df: DataFrame, interval: str = GATEWAY_FLUSH, gateway: str = "gateway_id",
                  type_col: str = "data_type", value: str = "value",
                  time_col: str = "ts", extra: Sequence[str] = ()) -> DataFrame:
    """A2 + F5 (summary form): one row per (gateway, flush interval, type) that
    has items -- empty types and empty batches are never produced.  ``extra`` columns
    divide the groups further."""
    w = F.window(F.col(time_col).cast("timestamp"), interval)
    return (df.groupBy(gateway, w.alias("flush"), type_col, *extra)
              .agg(F.count(F.lit(1)).alias("items"), F.sum(F.col(value)).alias("value_sum"))
              .select(gateway, F.col("flush.start").alias("flush_start"), type_col, *extra, "items",
                      "value_sum"))


def batch_envelopes(df: DataFrame, interval: str = GATEWAY_FLUSH, gateway: str = "gateway_id",
                    type_col: str = "data_type", value: str = "value", device: str = "device_id",
                    time_col: str = "ts") -> DataFrame:
    """A2 (envelope form): ``{gateway, flush_start, Data: [{DataType, Data:
    [{Value, WavyId}]}]}`` per gateway and flush interval.  A list holds one
    gateway's readings of one interval, bounded by its rate times the interval.
    Items are ordered by (ts, seq) for a stable encoding."""
    w = F.window(F.col(time_col).cast("timestamp"), interval)
    item = F.struct(F.col(time_col).alias("_t"), F.col("seq").alias("_s"),
                    F.col(value).cast("double").alias(VALUE_FIELD),
                    F.coalesce(F.col(device), F.lit(UNKNOWN_ID)).alias(ID_FIELD))
    per_type = (df.groupBy(gateway, w.alias("flush"), type_col)
                  .agg(F.array_sort(F.collect_list(item)).alias("_items"))
                  .select(gateway, "flush", F.struct(F.col(type_col).alias(TYPE_FIELD),
                          F.transform("_items", lambda x: F.struct(x[VALUE_FIELD].alias(VALUE_FIELD),
                                                                   x[ID_FIELD].alias(ID_FIELD)))
                          .alias(DATA_FIELD)).alias("group")))
    return (per_type.groupBy(gateway, "flush")
                    .agg(F.array_sort(F.collect_list("group")).alias(DATA_FIELD))
                    .select(F.col(gateway).alias(GATEWAY_FIELD),
                            F.col("flush.start").alias("flush_start"), DATA_FIELD))


def type_counts(df: DataFrame, type_col: str = "data_type") -> DataFrame:
    """A3: readings per type in the buffer."""
    return df.groupBy(type_col).agg(F.count(F.lit(1)).alias("readings"))


def type_sample(df: DataFrame, k: int = 5, type_col: str = "data_type",
                order: Sequence[str] = ("ts", "seq"), time_col: str = "ts",
                bucket_seconds: int = 60) -> DataFrame:
    """The first ``k`` readings per type (by time) and how many more the
    type holds (``more`` = rows - k, at least 0).  Skew-safe: the few types
    are never ordered inside one task."""
    s = first_k_per_key(df, [type_col], order, k, time_col, bucket_seconds,
                        rank_col="sample_rank", total_col="_rows")
    return s.withColumn("more", F.greatest(F.col("_rows") - F.lit(k), F.lit(0)).cast("long")).drop("_rows")


def tag_reading(df: DataFrame, arrival=None, time_col: str = "ts") -> DataFrame:
    """A typed reading (type, value, device, arrival time); the arrival
    time is the source time when present, else the processing time."""
    t = F.coalesce(F.col(time_col).cast("timestamp"), arrival if arrival is not None
                   else F.current_timestamp())
    return df.withColumn(time_col, t)


def slim_items(df: DataFrame, value: str = "value", device: str = "device_id") -> DataFrame:
    """The slim item forwarded upstream, (Value, WavyId)."""
    return df.withColumn("item", F.struct(F.col(value).cast("double").alias(VALUE_FIELD),
                                          F.coalesce(F.col(device), F.lit(UNKNOWN_ID)).alias(ID_FIELD)))
