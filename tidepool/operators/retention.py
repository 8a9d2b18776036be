"""Inactivity and cascaded retention.

``now`` is a parameter (a timestamp Column).  Deletes are anti joins; the
inactive-id side is planned by Spark (AQE turns it into a broadcast join from
its measured size when it is small, a shuffle join otherwise), so no
unchecked broadcast is forced.  ``NOT IN`` is avoided on purpose (its
null-aware plan is a broadcast nested loop).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.schema import INACTIVITY_HOURS


def inactive(registry: DataFrame, now: Column, hours: float = INACTIVITY_HOURS,
             last_seen: str = "last_seen") -> DataFrame:
    """ids whose last-seen time is strictly older than ``now - hours``."""
    threshold = now.cast("timestamp") - F.make_dt_interval(secs=F.lit(float(hours) * 3600.0))
    return registry.filter(F.col(last_seen).cast("timestamp") < threshold)


def inactive_counts(devices: DataFrame, gateways: DataFrame, now: Column,
                    hours: float = INACTIVITY_HOURS) -> DataFrame:
    """A5: number of inactive devices and gateways, one row per entity kind."""
    d = inactive(devices, now, hours).agg(F.count(F.lit(1)).alias("inactive"))
    g = inactive(gateways, now, hours).agg(F.count(F.lit(1)).alias("inactive"))
    return (d.select(F.lit("device").alias("entity"), "inactive")
             .unionByName(g.select(F.lit("gateway").alias("entity"), "inactive")))


def apply_retention(measurements: DataFrame, mappings: DataFrame, devices: DataFrame,
                    gateways: DataFrame, now: Column, hours: float = INACTIVITY_HOURS,
                    device: str = "device_id", gateway: str = "gateway_id") -> dict[str, DataFrame]:
    """The cascade, in order -- measurements of inactive devices, then of
    inactive gateways, mappings touching either, then the devices and the
    gateways themselves.  Returns the surviving tables."""
    dead_d = inactive(devices, now, hours).select(device)
    dead_g = inactive(gateways, now, hours).select(gateway)
    m = (measurements.join(dead_d, device, "left_anti").join(dead_g, gateway, "left_anti"))
    mp = mappings.join(dead_d, device, "left_anti").join(dead_g, gateway, "left_anti")
    return {
        "measurements": m,
        "mappings": mp,
        "devices": devices.join(dead_d, device, "left_anti"),
        "gateways": gateways.join(dead_g, gateway, "left_anti"),
    }


def retention_report(measurements: DataFrame, mappings: DataFrame, devices: DataFrame, gateways: DataFrame,
                     now: Column, hours: float = INACTIVITY_HOURS, device: str = "device_id",
                     gateway: str = "gateway_id") -> DataFrame:
    """Rows per table before and after the cascade of ``apply_retention``, from
    one pass over each table that marks the rows to go."""
    dead_d = inactive(devices, now, hours).select(F.col(device).alias("_dead_d"))
    dead_g = inactive(gateways, now, hours).select(F.col(gateway).alias("_dead_g"))

    def counted(name: str, df: DataFrame, by_device: bool, by_gateway: bool) -> DataFrame:
        lives = F.lit(True)
        if by_device:
            df, lives = df.join(dead_d, F.col(device) == F.col("_dead_d"), "left"), lives & F.col("_dead_d").isNull()
        if by_gateway:
            df, lives = df.join(dead_g, F.col(gateway) == F.col("_dead_g"), "left"), lives & F.col("_dead_g").isNull()
        return (df.agg(F.count(F.lit(1)).alias("before_rows"), F.count_if(lives).alias("after_rows"))
                  .select(F.lit(name).alias("table_name"), "before_rows", "after_rows"))

    rows = counted("measurements", measurements.select(device, gateway), True, True)
    for part in (counted("mappings", mappings.select(device, gateway), True, True),
                 counted("devices", devices.select(device), True, False),
                 counted("gateways", gateways.select(gateway), False, True)):
        rows = rows.unionByName(part)
    return rows.withColumn("removed_rows", F.col("before_rows") - F.col("after_rows"))
