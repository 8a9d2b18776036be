"""Measurement and metric tables: writes, ranged reads, table counts
(S13, S14, S16, A4, P8, T9).

Tables are Parquet datasets partitioned by ``data_type`` and ``day`` so that a
history read by device and time range prunes partitions and pushes the
remaining predicates into the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ("data_type", "day")


def _with_day(df: DataFrame, time_col: str = "ts") -> DataFrame:
    return df.withColumn("day", F.to_date(F.col(time_col).cast("timestamp")))


def _clustered(df: DataFrame, time_col: str) -> DataFrame:
    """Rows grouped by table partition before writing.  Spark splits the large
    partitions and merges the small ones from their measured sizes, so a hot
    (type, day) is written by as many tasks as it needs and a small one by one."""
    return _with_day(df, time_col).hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS)


def write_measurements(df: DataFrame, path: str, mode: str = "append", time_col: str = "ts") -> None:
    """Append measurements (device, gateway, type, value, time and the
    validation flags when present), partitioned by type and day."""
    _clustered(df, time_col).write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def write_metrics(df: DataFrame, path: str, mode: str = "append", time_col: str = "ts") -> None:
    """Append calculated metrics, same layout as the measurements."""
    _clustered(df, time_col).write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int, time_col: str = "ts",
                part_col: str = "stream_batch") -> None:
    """All-or-nothing, idempotent write of one batch: the batch lands in
    its own ``stream_batch=`` partition, replaced as a whole on a re-run
    (dynamic partition overwrite), so a resent batch never duplicates rows.
    A micro-batch is small, so it is not split by type and day; compact finished
    batches with ``write_measurements``."""
    out = _with_day(df, time_col).hint("rebalance").withColumn(part_col, F.lit(int(batch_id)).cast("long"))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(part_col).parquet(path))


def history_range(df: DataFrame, device: str | Column | None, start, end,
                  device_col: str = "device_id", time_col: str = "ts") -> DataFrame:
    """Readings of a device (all devices when ``device`` is None) with
    ``start <= ts < end``; ``day`` bounds are added when the table has the
    column, which prunes partitions."""
    t = F.col(time_col).cast("timestamp")
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    cond = (t >= lo) & (t < hi)
    if "day" in df.columns:
        cond = cond & (F.col("day") >= F.to_date(lo)) & (F.col("day") <= F.to_date(hi))
    if device is not None:
        cond = cond & (F.col(device_col) == (device if isinstance(device, Column) else F.lit(device)))
    return df.filter(cond)


def read_history(spark: SparkSession, path: str, device, start, end, **kw) -> DataFrame:
    """S16 on a written table: partition pruning on ``day`` plus pushed-down
    filters on device and time."""
    return history_range(spark.read.parquet(path), device, start, end, **kw)


def with_epoch_millis(df: DataFrame, time_col: str = "ts") -> DataFrame:
    """The wire form of a time (epoch milliseconds) and back (ms precision)."""
    ms = F.unix_millis(F.col(time_col).cast("timestamp"))
    return df.withColumn("ts_ms", ms).withColumn("ts_roundtrip", F.timestamp_millis(ms))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def drop_folders(spark: SparkSession, folders: Sequence[str]) -> None:
    """Removes whole partition folders, given as file URIs: a step of the file system, for which Spark
    has no writer."""
    jvm = spark.sparkContext._jvm
    for folder in folders:
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table_counts(spark: SparkSession, names: Sequence[str], locate: Callable[[str], str]) -> DataFrame:
    """A4: rows per table, -1 for a table that does not exist.  Each count is
    a Parquet metadata count; only the existence checks run on the driver."""
    parts = []
    for name in names:
        path = locate(name)
        if path_exists(spark, path):
            parts.append(spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"))
                         .select(F.lit(name).alias("table_name"), "row_count"))
        else:
            parts.append(spark.range(1).select(F.lit(name).alias("table_name"),
                                               F.lit(-1).cast("long").alias("row_count")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dedupe_resends(df: DataFrame, payload_col: str = "payload", order: Sequence[str] = ("code", "seq"),
                   keep: Sequence[str] = (), key_cols: Sequence[str] = ()) -> DataFrame:
    """T8 (batch form): a resent batch carries the same payload as the first
    send.  The batch key is the sender/send-window columns ``key_cols`` plus
    the SHA-256 of the payload (equal content from different windows stays
    apart); the first copy by ``order`` is kept and ``copies`` counts the
    sends.  A partial aggregation: one hot key costs one partial row per task."""
    key = F.sha2(F.col(payload_col), 256)
    carry = [c for c in (*order, *keep, payload_col) if c not in key_cols]
    first = F.min_by(F.struct(*[F.col(c) for c in carry]), F.struct(*[F.col(c) for c in order]))
    g = df.withColumn("batch_key", key).groupBy(*key_cols, "batch_key").agg(
        first.alias("_f"), F.count(F.lit(1)).alias("copies"))
    return g.select(*key_cols, "batch_key", "copies", *[F.col(f"_f.{c}").alias(c) for c in carry])
