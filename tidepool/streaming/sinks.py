"""T8 resend de-duplication, T9 all-or-nothing batch writes, T10 the
stream-static subscription gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.sources.history import write_batch


def dedupe_stream(batches: DataFrame, key_cols: Sequence[str], payload_col: str = "payload",
                  time_col: str = "batch_time", watermark: str = "10 minutes") -> DataFrame:
    """Drop resent copies of a batch (same sender/window key and same
    payload hash) that arrive within the watermark; state is bounded by it."""
    b = (batches.withColumn(time_col, F.col(time_col).cast("timestamp"))
                .withColumn("batch_key", F.sha2(F.col(payload_col), 256))
                .withWatermark(time_col, watermark))
    return b.dropDuplicatesWithinWatermark([*key_cols, "batch_key"])


def start_batch_writer(stream: DataFrame, out_path: str, checkpoint: str, transform=None,
                       available_now: bool = True):
    """Each micro-batch is written as one unit into ``stream_batch=<id>``
    (dynamic partition overwrite): a retried batch replaces its own partition,
    a failed one leaves nothing behind that readers would take for data."""

    def step(df: DataFrame, batch_id: int) -> None:
        out = transform(df) if transform is not None else df
        write_batch(out, out_path, batch_id)

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def gate_stream(readings: DataFrame, subscriptions: DataFrame, type_col: str = "data_type") -> DataFrame:
    """A stream-static left semi join with the (per-type) subscription table."""
    s = subscriptions.select(F.col(type_col).alias("_topic")).distinct()
    return readings.join(s, F.col(type_col) == F.col("_topic"), "left_semi")
