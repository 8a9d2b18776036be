"""T1 gateway flush and T2 device interval sums on a stream, and T6 presence as the last
event per device.

Sums and counts of a window can be added up, so a micro-batch needs no state of the
windows before it: it writes the sums of its own rows, aggregated map-side, under its batch
number (``commits``), and a reader adds up what the batches wrote.  No reading is dropped, however late it
comes.  A reading whose window had ended, by the allowed ``delay``, behind the newest time of
the batches before is *late*: it counts in ``late_items`` of its window as well, and
goes to the table ``late`` as it is, so that receivers of a window that was already sent can be
told.  ``fold_window_sums`` merges what has piled up to one row per window.

T6 works the same way: a micro-batch writes the last event of each of its devices, and a reader takes
the last of those.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import batching as B
from tidepool.schema import DEVICE_INTERVAL, GATEWAY_FLUSH
from tidepool.streaming import commits as C

DEFAULT_DELAY = "1 minute"
SUMS, LATE, PROGRESS, PRESENCE = "sums", "late", "progress", "presence"
PRESENCE_SCHEMA = "device_id string, state string, since timestamp, seq long"
PROGRESS_SCHEMA = "newest timestamp"


class WindowSums(NamedTuple):
    """Sums per window: ``aggregate`` groups by ``keys`` and the column ``late`` and adds the ``sums``."""

    aggregate: Callable[[DataFrame], DataFrame]
    interval: str
    schema: str
    keys: tuple[str, ...]
    sums: tuple[str, ...]


def flush_sums(interval: str = GATEWAY_FLUSH) -> WindowSums:
    """Items and value sum per (gateway, flush interval, type)."""
    return WindowSums(partial(B.batch_by_type, interval=interval, extra=("late",)), interval,
                      "gateway_id string, flush_start timestamp, data_type string, late boolean, items long, value_sum double",
                      ("gateway_id", "flush_start", "data_type"), ("items", "value_sum"))


def interval_sums(interval: str = DEVICE_INTERVAL) -> WindowSums:
    """Per device, type and interval the sum of truncated values."""
    return WindowSums(partial(B.interval_sum, interval=interval, keys=("device_id", "data_type", "late")), interval,
                      "device_id string, data_type string, late boolean, interval_start timestamp, interval_end timestamp, total long, items long",
                      ("device_id", "data_type", "interval_start", "interval_end"), ("total", "items"))


def newest_before(spark: SparkSession, root: str, batch_id: int):
    """Newest time of the batches before this one, or None; each batch carries it on."""
    rows = C.read_committed(spark, root, PROGRESS, PROGRESS_SCHEMA, batch_id - 2, batch_id - 1)
    return rows.agg(F.max("newest")).first()[0]


def start_window_sums(readings: DataFrame, sums: WindowSums, root: str, checkpoint: str, delay: str = DEFAULT_DELAY,
                      time_col: str = "ts", available_now: bool = True):
    """Start the stream; read the result with ``window_sums``."""
    at = F.col(time_col).cast("timestamp")

    def tables(batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        newest = newest_before(batch.sparkSession, root, batch_id)
        ended = F.lit(False) if newest is None else F.coalesce(F.window(at, sums.interval)["end"] <= F.lit(newest) - F.expr(f"INTERVAL {delay}"), F.lit(False))
        marked = batch.withColumn("late", ended)
        return {SUMS: sums.aggregate(marked), LATE: marked.filter("late").drop("late"), PROGRESS: batch.agg(F.greatest(F.max(at), F.lit(newest).cast("timestamp")).alias("newest"))}

    return C.start_together(readings, root, checkpoint, tables, available_now)


def _added(sums: WindowSums) -> C.Merge:
    def merge(df: DataFrame) -> DataFrame:
        return df.groupBy(*sums.keys, "late").agg(*[F.sum(c).alias(c) for c in sums.sums]).select(*df.columns)

    return merge


def window_sums(spark: SparkSession, root: str, sums: WindowSums) -> DataFrame:
    """The sums of every window over all committed batches, with the number of its late items."""
    rows = C.read_merged(spark, root, SUMS, sums.schema, _added(sums))
    return rows.groupBy(*sums.keys).agg(*[F.sum(c).alias(c) for c in sums.sums],
                                        F.sum(F.when(F.col("late"), F.col("items")).otherwise(0)).alias("late_items"))


def fold_window_sums(spark: SparkSession, root: str, sums: WindowSums) -> int:
    return C.fold(spark, root, SUMS, sums.schema, _added(sums))


def late_readings(spark: SparkSession, root: str, schema) -> DataFrame:
    """The readings that came after their window had ended."""
    return C.read_committed(spark, root, LATE, schema).drop("stream_batch")


def _last_events(df: DataFrame) -> DataFrame:
    """Per device the event that came last by time, then by ``seq``."""
    at = F.struct("since", "seq")
    return df.groupBy("device_id").agg(F.max_by(F.struct("state", "since", "seq"), at).alias("_l")).select("device_id", "_l.*")


def start_presence(events: DataFrame, root: str, checkpoint: str, device: str = "device_id", kind: str = "kind", time_col: str = "ts",
                   available_now: bool = True):
    """Connect and disconnect events; read the current states with ``current_presence``.
    A batch writes the last event of each of its devices, so it needs no state."""

    def tables(batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        rows = batch.select(F.col(device).alias("device_id"), F.col(kind).alias("state"), F.col(time_col).cast("timestamp").alias("since"),
                            F.col("seq").cast("long").alias("seq"))
        return {PRESENCE: _last_events(rows)}

    return C.start_together(events, root, checkpoint, tables, available_now)


def current_presence(spark: SparkSession, root: str) -> DataFrame:
    """``device_id, state, since, connected`` as of the last batch."""
    rows = C.read_merged(spark, root, PRESENCE, PRESENCE_SCHEMA, _last_events)
    return rows.select("device_id", "state", "since", (F.col("state") == F.lit("connect")).alias("connected"))


def fold_presence(spark: SparkSession, root: str) -> int:
    return C.fold(spark, root, PRESENCE, PRESENCE_SCHEMA, _last_events)
