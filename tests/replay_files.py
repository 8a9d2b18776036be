"""A table as a sequence of small files in time order, for streams with many micro-batches."""

from pyspark.sql import functions as F


def replay_files(df, path, time_col="ts", chunk_seconds=5 * 86400, order=("ts", "seq")):
    chunk = F.floor(F.unix_seconds(F.col(time_col).cast("timestamp")) / F.lit(chunk_seconds)).cast("long")
    d = df.withColumn("_chunk", chunk).persist()
    try:
        for (c,) in d.select("_chunk").distinct().orderBy("_chunk").collect():
            d.filter(F.col("_chunk") == c).drop("_chunk").coalesce(1).sortWithinPartitions(*order).write.mode("append").parquet(path)
    finally:
        d.unpersist()
