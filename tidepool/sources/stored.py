"""Registry tables kept on disk: upserts and deletes that rewrite only the partitions concerned
(A9, A10, J5, J1, X3 as writes).

A registry lies in hash buckets of its ids (``bucket=`` partitions).  An upsert reads the buckets
that its ids fall in, merges, and replaces those partitions (dynamic overwrite: Spark
stages the new files and moves a partition into place).  The merges keep the first or last row of
an id, so doing one again changes nothing, and a killed upsert is mended by its retry.

A retention run counts first and changes nothing.  Executing it rewrites the partitions that hold
some dead rows, drops those that hold nothing else, and leaves the others untouched;
measurements and mappings go before the registries, so that a killed run can be planned and executed
again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.registry import mapping_upsert, registry_upsert
from tidepool.operators.retention import inactive
from tidepool.schema import INACTIVITY_HOURS
from tidepool.session import scratch_dir
from tidepool.sources.history import drop_folders, path_exists

BUCKETS = 64

# merge(stored rows or None, updates) -> rows of the registry
Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def bucket_of(ids: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in ids]), F.lit(buckets)).cast("int")


def merge_registry(id_col: str) -> Merge:
    """Last seen per id."""
    return lambda stored, updates: registry_upsert(stored, updates, [id_col])


def merge_mapping(stored: DataFrame | None, updates: DataFrame) -> DataFrame:
    """A10: first and last connection per device and gateway."""
    return mapping_upsert(stored, updates)


def upsert(path: str, updates: DataFrame, ids: Sequence[str], merge: Merge, buckets: int = BUCKETS) -> list[int]:
    """Merges ``updates`` into the table at ``path``; returns the buckets that were rewritten.
    ``buckets`` belongs to the table and must stay the same."""
    spark = updates.sparkSession
    updates = updates.withColumn("bucket", bucket_of(ids, buckets))
    touched = sorted(r["bucket"] for r in updates.select("bucket").distinct().collect())       # at most ``buckets`` numbers
    if not touched:
        return touched
    stored = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).drop("bucket") if path_exists(spark, path) else None
    rows = merge(stored, updates.drop("bucket")).withColumn("bucket", bucket_of(ids, buckets))
    (rows.hint("rebalance", "bucket").sortWithinPartitions("bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))
    return touched


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


class Registries(NamedTuple):
    """Folders of the stored tables; measurements may be partitioned in any way."""

    measurements: str
    mappings: str
    devices: str
    gateways: str


def upsert_registries(readings: DataFrame, at: Registries, buckets: int = BUCKETS, device: str = "device_id", gateway: str = "gateway_id") -> None:
    """Devices, gateways and mappings from readings."""
    upsert(at.devices, readings, [device], merge_registry(device), buckets)
    upsert(at.gateways, readings, [gateway], merge_registry(gateway), buckets)
    upsert(at.mappings, readings, [device, gateway], merge_mapping, buckets)


def start_registry_stream(readings: DataFrame, at: Registries, checkpoint: str, buckets: int = BUCKETS, available_now: bool = True):
    """Each micro-batch is upserted; a retried one changes nothing."""

    def step(df: DataFrame, batch_id: int) -> None:
        df = df.persist()               # three tables come from it
        try:
            upsert_registries(df, at, buckets)
        finally:
            df.unpersist()

    w = readings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


class PartitionCounts(NamedTuple):
    values: tuple            # of the partition columns
    folder: str
    rows: int
    dead: int


class TablePlan(NamedTuple):
    name: str
    path: str
    partition_by: tuple[str, ...]
    dead_by: tuple[str, ...]
    partitions: list[PartitionCounts]       # those that hold dead rows
    rows: int
    dead: int


class RetentionPlan(NamedTuple):
    dead: dict[str, DataFrame]              # ids, stored
    tables: list[TablePlan]

    def report(self, spark: SparkSession) -> DataFrame:
        """Rows per table now and after the run."""
        return spark.createDataFrame([(t.name, t.rows, t.rows - t.dead, t.dead) for t in self.tables],
                                     "table_name string, before_rows long, after_rows long, removed_rows long")


def _marked(rows: DataFrame, dead: dict[str, DataFrame], by: Sequence[str]) -> DataFrame:
    goes = F.lit(False)
    for column in by:
        ids = dead[column].select(F.col(column).alias(f"_dead_{column}"))
        rows = rows.join(ids, F.col(column) == F.col(f"_dead_{column}"), "left")
        goes = goes | F.col(f"_dead_{column}").isNotNull()
    return rows.withColumn("_goes", goes).drop(*[f"_dead_{c}" for c in by])


def _plan_table(spark: SparkSession, name: str, path: str, partition_by: Sequence[str], dead: dict[str, DataFrame], by: Sequence[str]) -> TablePlan:
    rows = spark.read.parquet(path).select(*by, *[c for c in partition_by if c not in by], F.col("_metadata.file_path").alias("_file"))
    counts = _marked(rows, dead, by).groupBy(*partition_by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_goes").alias("dead"), F.min("_file").alias("file")).persist()
    try:
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("dead"), F.lit(0))).first()
        # one row per partition concerned
        found = [PartitionCounts(tuple(r[c] for c in partition_by), r["file"].rpartition("/")[0], r["n"], r["dead"])
                 for r in counts.filter("dead > 0").collect()]
    finally:
        counts.unpersist()
    return TablePlan(name, path, tuple(partition_by), tuple(by), found, int(total[0]), int(total[1]))


def plan_retention(spark: SparkSession, at: Registries, now: Column, hours: float = INACTIVITY_HOURS, device: str = "device_id",
                   gateway: str = "gateway_id", measurement_partitions: Sequence[str] = ("data_type", "day")) -> RetentionPlan:
    """What a retention run would remove: the inactive ids, and per table and partition the rows.  Nothing is changed."""
    dead = {}
    for column, path in ((device, at.devices), (gateway, at.gateways)):
        folder = scratch_dir(spark, f"inactive-{column}")
        inactive(spark.read.parquet(path), now, hours).select(column).write.parquet(folder)
        dead[column] = spark.read.parquet(folder)
    plans = [("measurements", at.measurements, measurement_partitions, [device, gateway]), ("mappings", at.mappings, ["bucket"], [device, gateway]),
             ("devices", at.devices, ["bucket"], [device]), ("gateways", at.gateways, ["bucket"], [gateway])]
    return RetentionPlan(dead, [_plan_table(spark, *p[:3], dead, p[3]) for p in plans])


def _among(columns: Sequence[str], partitions: Sequence[PartitionCounts]) -> Column:
    """Rows of some partitions, as a filter on partition columns only: the last column's values are
    listed per combination of the others."""
    groups: dict[tuple, list] = {}
    for p in partitions:
        groups.setdefault(p.values[:-1], []).append(p.values[-1])
    found = F.lit(False)
    for head, values in groups.items():
        one = F.col(columns[-1]).isin([v for v in values if v is not None])
        if None in values:
            one = one | F.col(columns[-1]).isNull()
        for c, v in zip(columns, head):
            one = one & F.col(c).eqNullSafe(F.lit(v))
        found = found | one
    return found


def execute_retention(spark: SparkSession, plan: RetentionPlan) -> None:
    """Removes what the plan counted."""
    for t in plan.tables:
        mixed = [p for p in t.partitions if p.dead < p.rows]
        if mixed:
            rows = spark.read.parquet(t.path)
            stays = _marked(rows.filter(_among(t.partition_by, mixed)), plan.dead, t.dead_by).filter(~F.col("_goes")).drop("_goes")
            (stays.select(rows.columns).hint("rebalance", *t.partition_by).sortWithinPartitions(*t.partition_by).write.mode("overwrite")
                  .option("partitionOverwriteMode", "dynamic").partitionBy(*t.partition_by).parquet(t.path))
        drop_folders(spark, [p.folder for p in t.partitions if p.dead == p.rows])
