"""Rolling metrics over the last ``n`` readings of each (device, type).

Semantics per reading, its own value included in the history:

* ``average_value``      mean of the last ``n`` values
* ``variance``           population variance, 0.0 when fewer than 2 values
* ``std_dev``            square root of ``variance``
* ``trend_coefficient``  least-squares slope over the sample index, 0.0 when
                         fewer than 3 values
* ``normalized_value``   z-score of the reading, 0.0 unless n > 1 and variance > 0
* ``anomaly_score``      absolute z-score

All of it is one sliding frame over skew-safe positions
(``plans.windows``): no Python, no per-key task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.plans.windows import (DEFAULT_BUCKET_SECONDS, DEFAULT_CHUNK_ROWS,
                                    chunked_rolling, keyed_positions, last_k_per_key)
from tidepool.schema import ANOMALY_SIGMAS, HISTORY_SIZE

KEYS = ("device_id", "data_type")
ORDER = ("ts", "seq")

METRIC_COLUMNS = ["average_value", "variance", "std_dev", "trend_coefficient",
                  "normalized_value", "anomaly_score"]


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def rolling_metrics(
    df: DataFrame,
    n: int = HISTORY_SIZE,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    value: str = "value",
    time_col: str = "ts",
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
    regression: bool = False,
    bucket: Column | None = None,
) -> DataFrame:
    """W1-W6 (and W12 with ``regression=True``): add the metric columns and
    ``history_size`` to every reading.  ``bucket`` as in ``keyed_positions``."""
    pos = keyed_positions(df, keys, order, time_col, bucket_seconds, index_col="_pos", bucket=bucket)
    v = F.col(value)
    # Positions inside a frame are consecutive, so the abscissa's mean and
    # variance are closed forms ((n-1)/2 from the oldest, (n^2-1)/12): one
    # covariance per frame gives slope, intercept and r2.
    exprs = {
        "history_size": lambda f, x: F.count(v).over(f()),
        "average_value": lambda f, x: F.avg(v).over(f()),
        "_var": lambda f, x: F.var_pop(v).over(f()),
        "_cov": lambda f, x: F.covar_pop(v, x).over(f()),
    }
    if regression:
        exprs["window_start"] = lambda f, x: F.min(F.col(time_col)).over(f())
    out = chunked_rolling(pos, keys, "_pos", n, exprs, chunk_rows)

    size = F.col("history_size")
    var_x = (size.cast("double") * size - F.lit(1.0)) / F.lit(12.0)
    slope = F.when(size > 2, F.coalesce(F.col("_cov") / var_x, F.lit(0.0))).otherwise(F.lit(0.0))
    var = F.when(size > 1, F.col("_var")).otherwise(F.lit(0.0))
    out = out.withColumn("variance", var)
    # NaN compares above everything in Spark; the reference's comparisons are
    # false for NaN, so test finiteness explicitly.
    pos_var = (F.col("variance") > 0) & ~F.isnan(F.col("variance"))
    z = F.when((size > 1) & pos_var,
               (v - F.col("average_value")) / F.sqrt(F.col("variance"))).otherwise(F.lit(0.0))
    out = (out.withColumn("std_dev", F.sqrt(F.col("variance")))
              .withColumn("trend_coefficient", slope)
              .withColumn("normalized_value", z)
              .withColumn("anomaly_score", F.abs(z)))
    if regression:
        # x = 0 is the oldest value in the frame; r2 is 1 for a flat frame
        r2 = (F.when(F.col("variance") == 0, F.lit(1.0))
               .otherwise(F.col("_cov") * F.col("_cov") / (var_x * F.col("variance"))))
        out = (out.withColumn("slope", F.col("trend_coefficient"))
                  .withColumn("intercept", F.col("average_value")
                              - F.col("slope") * (size - F.lit(1)).cast("double") / F.lit(2.0))
                  .withColumn("r2", F.when(size > 2, F.coalesce(r2, F.lit(0.0))).otherwise(F.lit(0.0))))
    return out.drop("_var", "_cov", "_pos")


def classify_anomaly(df: DataFrame, score: str = "anomaly_score",
                     anomaly: float = ANOMALY_SIGMAS, warning: float = 2.0) -> DataFrame:
    """Label a reading ``anomaly`` (score > 3), ``warning`` (> 2) or ``normal``."""
    s = F.col(score)
    label = (F.when(s > F.lit(anomaly), "anomaly")
              .when(s > F.lit(warning), "warning")
              .otherwise("normal"))
    return df.withColumn("anomaly_class", label)


def metrics_long(df: DataFrame, keys: Sequence[str] = KEYS, time_col: str = "ts",
                 metrics: Sequence[str] = tuple(METRIC_COLUMNS),
                 ids: Sequence[str] = ("seq",)) -> DataFrame:
    """One row per (reading, metric) with the frame's time range
    (``window_start`` from ``rolling_metrics(regression=True)``, else the
    reading's own time)."""
    start = F.col("window_start") if "window_start" in df.columns else F.col(time_col)
    base = df.select(*keys, *ids, F.col(time_col).alias("window_end"),
                     start.alias("window_start"), *[F.col(m).cast("double") for m in metrics])
    return base.unpivot([*keys, *ids, "window_start", "window_end"], list(metrics),
                        "metric_type", "metric_value")


def last_n_history(df: DataFrame, n: int = HISTORY_SIZE, keys: Sequence[str] = KEYS,
                   order: Sequence[str] = ORDER, time_col: str = "ts",
                   bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """The bounded history snapshot, last ``n`` readings per key."""
    return last_k_per_key(df, keys, order, n, time_col, bucket_seconds)


def metrics_with_fallback(df: DataFrame, value: str = "value", **kw) -> DataFrame:
    """J4 + T11: every reading is kept as a measurement; metrics are computed
    over the finite readings only and are NULL for the others (the metric
    service fails on them, the measurement is stored anyway)."""
    ok = _finite(F.col(value)) & F.col(value).isNotNull()
    good = rolling_metrics(df.filter(ok), value=value, **kw)
    bad = df.filter(~ok | F.col(value).isNull())
    for c in ["history_size"] + METRIC_COLUMNS:
        bad = bad.withColumn(c, F.lit(None).cast("long" if c == "history_size" else "double"))
    return (good.withColumn("metrics_ok", F.lit(True))
                .unionByName(bad.withColumn("metrics_ok", F.lit(False))))


def contextual_anomaly(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "value",
                       time_col: str = "ts", period: str = "1 day",
                       min_history: int = 5, sigmas: float = ANOMALY_SIGMAS) -> DataFrame:
    """Compare each reading with the previous period's statistics of its
    key (tumbling windows; equi join on period start)."""
    per = F.window(F.col(time_col).cast("timestamp"), period)
    stats = (df.groupBy(*keys, per.alias("_w"))
               .agg(F.count(F.col(value)).alias("prev_n"),
                    F.avg(F.col(value)).alias("prev_mean"),
                    F.stddev_pop(F.col(value)).alias("prev_std"))
               .select(*keys, F.col("_w.end").alias("period_start"),
                       "prev_n", "prev_mean", "prev_std"))
    cur = df.withColumn("period_start", per.getField("start"))
    out = cur.join(stats, on=[*keys, "period_start"], how="left")
    v = F.col(value)
    dev = F.abs(v - F.col("prev_mean"))
    flag = (F.coalesce(F.col("prev_n"), F.lit(0)) >= min_history) & _finite(v) & \
        (dev > F.lit(sigmas) * F.col("prev_std"))
    return out.withColumn("contextual_anomaly", F.coalesce(flag, F.lit(False)))
