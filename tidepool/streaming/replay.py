"""A table fed to a stream in parts.

A live deployment reads a broker or a landing folder.  To run a stream over a table, its rows arrive in
a few parts, in time order, each written to the landing folder by one distributed job; the
stream takes a part and stops, and goes on from its checkpoint with the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def split_by_time(df: DataFrame, cuts: Sequence[str], time_col: str = "ts") -> list[DataFrame]:
    """The rows before the first cut (and those without a time), between each two, and from the last on."""
    at = F.col(time_col).cast("timestamp")
    edges = [F.to_timestamp(F.lit(c)) for c in cuts]
    parts = []
    for i in range(len(edges) + 1):
        begin = at >= edges[i - 1] if i else F.lit(True)
        end = F.coalesce(at < edges[i], F.lit(i == 0)) if i < len(edges) else F.lit(True)
        parts.append(df.filter(begin & end))
    return parts


def run_in_parts(parts: Sequence[DataFrame], path: str, *starts: Callable[[DataFrame], StreamingQuery]) -> None:
    """Each part lands in ``path``, then every query of ``starts`` reads what is new there and stops."""
    for part in parts:
        part.write.mode("append").parquet(path)
        for start in starts:
            run_available_now(lambda: start(read_landing(part.sparkSession, path, part.schema)))


def read_landing(spark: SparkSession, path: str, schema) -> DataFrame:
    """All new files of a folder in one micro-batch."""
    return spark.readStream.schema(schema).parquet(path)


def read_replay(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
                 .parquet(path))


def run_available_now(start: Callable[[], StreamingQuery], timeout_s: int = 1800) -> None:
    """Run a query until the data present at start is processed."""
    q = start()
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("streaming query did not finish")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def to_parquet(sdf: DataFrame, out: str, checkpoint: str, mode: str = "append") -> Callable[[], StreamingQuery]:
    """A file sink (exactly-once through its commit log) run as availableNow."""
    return lambda: (sdf.writeStream.format("parquet").outputMode(mode)
                       .option("path", out).option("checkpointLocation", checkpoint)
                       .trigger(availableNow=True).start())
