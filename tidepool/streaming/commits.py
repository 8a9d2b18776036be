"""Several tables written by one micro-batch, visible together.

A batch writes its rows of every table into the partition ``stream_batch=N`` of that
table, and last a row into ``commits/stream_batch=N``.  Every write replaces its own partition
(dynamic overwrite: Spark stages the files and moves the partition into place), so a retry
leaves no duplicate, and readers take only batches up to the last commit: a batch that was
killed between two writes is invisible as a whole until its retry has written all of them.
Batches of a query run one after the other, so all up to the last commit are complete.

``fold`` merges the batches so far into one partition ``upto=N`` of a second table, for tables
that are read as one row per key; readers then take the fold and the batches after it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidepool.sources.history import path_exists

COMMITS, FOLDED = "commits", "folded"


def _path(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), *parts])


def _replace(df: DataFrame, path: str, column: str, number: int) -> None:
    (df.withColumn(column, F.lit(int(number)).cast("long")).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path))


def write_together(spark: SparkSession, root: str, batch_id: int, tables: Mapping[str, DataFrame]) -> None:
    """The rows of one batch into each table, then the commit."""
    for name, df in tables.items():
        _replace(df.hint("rebalance"), _path(root, name), "stream_batch", batch_id)
    done = spark.createDataFrame([(sorted(tables),)], "tables array<string>").withColumn("committed_at", F.current_timestamp())
    _replace(done, _path(root, COMMITS), "stream_batch", batch_id)


def last_commit(spark: SparkSession, root: str) -> int:
    """Number of the last batch whose tables are all there, -1 if there is none."""
    if not path_exists(spark, _path(root, COMMITS)):
        return -1
    n = spark.read.parquet(_path(root, COMMITS)).agg(F.max("stream_batch")).first()[0]
    return -1 if n is None else int(n)


def _numbered(schema: StructType, column: str) -> StructType:
    return StructType([*(StructField(f.name, f.dataType) for f in schema.fields if f.name != column), StructField(column, LongType())])


def read_committed(spark: SparkSession, root: str, name: str, schema: StructType | str, after: int = -1, upto: int | None = None) -> DataFrame:
    """Rows of the committed batches ``after < stream_batch <= upto`` (default: the last one).
    ``schema`` is that of the rows; a table without any batch is empty."""
    schema = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    upto = last_commit(spark, root) if upto is None else upto
    path = _path(root, name)
    if upto < 0 or not path_exists(spark, path):
        return spark.createDataFrame([], _numbered(schema, "stream_batch"))
    rows = spark.read.schema(_numbered(schema, "stream_batch")).parquet(path)
    return rows.filter((F.col("stream_batch") > after) & (F.col("stream_batch") <= upto))


Merge = Callable[[DataFrame], DataFrame]


def _last_fold(spark: SparkSession, root: str, name: str) -> int:
    path = _path(root, FOLDED, name)
    if not path_exists(spark, path):
        return -1
    n = spark.read.parquet(path).agg(F.max("upto")).first()[0]
    return -1 if n is None else int(n)


def read_merged(spark: SparkSession, root: str, name: str, schema: StructType | str, merge: Merge, upto: int | None = None) -> DataFrame:
    """A keyed table: ``merge`` over the last fold and the committed batches after it.
    ``merge`` keeps the columns of ``schema``, and merging merged rows again changes nothing."""
    schema = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    start = _last_fold(spark, root, name)
    rows = read_committed(spark, root, name, schema, start, upto).drop("stream_batch")
    if start >= 0:
        folded = spark.read.schema(_numbered(schema, "upto")).parquet(_path(root, FOLDED, name))
        rows = folded.filter(F.col("upto") == start).drop("upto").unionByName(rows)
    return merge(rows)


def fold(spark: SparkSession, root: str, name: str, schema: StructType | str, merge: Merge) -> int:
    """Merges all committed batches of a keyed table; returns the last batch in it.  A fold that
    is not finished is not there, and running it again replaces it."""
    upto = last_commit(spark, root)
    if upto > _last_fold(spark, root, name):
        _replace(read_merged(spark, root, name, schema, merge, upto).hint("rebalance"), _path(root, FOLDED, name), "upto", upto)
    return upto


def start_together(stream: DataFrame, root: str, checkpoint: str, tables: Callable[[DataFrame, int], Mapping[str, DataFrame]],
                   available_now: bool = True, done: Callable[[], None] | None = None):
    """``foreachBatch``: the micro-batch is held, ``tables(batch, batch_id)`` derives the rows of each
    table from it, and all are written under the batch's number; ``done`` is called after each batch, failed ones too."""

    def step(df: DataFrame, batch_id: int) -> None:
        df = df.persist()               # several tables come from it
        try:
            write_together(df.sparkSession, root, batch_id, tables(df, batch_id))
        finally:
            df.unpersist()
            if done is not None:
                done()

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def latest(keys: Sequence[str], order: str) -> Merge:
    """Merge: per key the row with the largest ``order``."""

    def merge(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_l"))
        return last.select(*[F.col(c) if c in keys else F.col(f"_l.{c}").alias(c) for c in df.columns])

    return merge
