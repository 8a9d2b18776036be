"""Registries by upsert and presence.

Upserts are aggregations: ``existing UNION new`` grouped by the id, with
``max_by(ts, seq)`` (the last *arriving* timestamp wins, not the largest) and
``min_by`` for first-seen.  Both are partially aggregated map-side, so one hot
id costs one partial row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.scalar import elapsed_hms


def registry_upsert(existing: DataFrame | None, updates: DataFrame, id_cols: Sequence[str],
                    ts_col: str = "ts", seq_col: str = "seq") -> DataFrame:
    """Last seen per id.  ``existing`` has (ids, last_seen, last_seq);
    ``updates`` has (ids, ts, seq)."""
    u = updates.select(*id_cols, F.col(ts_col).alias("last_seen"), F.col(seq_col).alias("last_seq"))
    both = u if existing is None else existing.select(*id_cols, "last_seen", "last_seq").unionByName(u)
    return both.groupBy(*id_cols).agg(
        F.max_by(F.struct("last_seen", "last_seq"), "last_seq").alias("_l")).select(
        *id_cols, F.col("_l.last_seen").alias("last_seen"), F.col("_l.last_seq").alias("last_seq"))


def mapping_upsert(existing: DataFrame | None, updates: DataFrame,
                   device: str = "device_id", gateway: str = "gateway_id",
                   ts_col: str = "ts", seq_col: str = "seq") -> DataFrame:
    """A10: device-gateway mapping; first connection kept, last replaced."""
    u = updates.select(device, gateway,
                       F.col(ts_col).alias("first_connected"), F.col(seq_col).alias("first_seq"),
                       F.col(ts_col).alias("last_connected"), F.col(seq_col).alias("last_seq"))
    both = u if existing is None else existing.select(*u.columns).unionByName(u)
    return both.groupBy(device, gateway).agg(
        F.min_by(F.struct("first_connected", "first_seq"), "first_seq").alias("_f"),
        F.max_by(F.struct("last_connected", "last_seq"), "last_seq").alias("_l")).select(
        device, gateway, F.col("_f.first_connected").alias("first_connected"),
        F.col("_f.first_seq").alias("first_seq"), F.col("_l.last_connected").alias("last_connected"),
        F.col("_l.last_seq").alias("last_seq"))


def presence(events: DataFrame, id_col: str = "device_id", kind_col: str = "kind",
             ts_col: str = "ts", seq_col: str = "seq") -> DataFrame:
    """connect/disconnect events -> current state per id and since when.
    A reconnect overwrites the earlier connection time."""
    last = events.groupBy(id_col).agg(
        F.max_by(F.struct(F.col(kind_col).alias("k"), F.col(ts_col).alias("t")),
                 F.struct(F.col(ts_col), F.col(seq_col))).alias("_l"))
    return last.select(id_col, F.col("_l.k").alias("state"), F.col("_l.t").alias("since"),
                       (F.col("_l.k") == F.lit("connect")).alias("connected"))


def connected_for(presence_df: DataFrame, now: Column, id_col: str = "device_id") -> DataFrame:
    """A11 + P13: connected ids with elapsed seconds and ``Xh Ym Zs`` text at
    ``now`` (a timestamp column, e.g. a literal or a scalar subquery)."""
    p = presence_df.filter(F.col("connected"))
    secs = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))
    return (p.withColumn("elapsed_seconds", F.floor(secs / F.lit(1_000_000)).cast("long"))
             .withColumn("elapsed_text", elapsed_hms("elapsed_seconds")))
