"""Gateway envelopes into the server's tables: one micro-batch, one commit.

Two streams.  The first decodes every envelope once into items, accepted or rejected, and writes
them through Spark's exactly-once file sink.  The second reads the items, with the last
values of their keys from the keyed state (``tails``), and writes measurements, rolling metrics,
rejects and the changes of the three registries under one batch number (``commits``): a batch that is
killed between two of these writes is invisible until its retry has written all of them.

The order inside a (device, type) is the envelope's time, then the envelope's number, then the place in it
(``seq`` packs the last two: 128 groups of 16 million items).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import metrics as M
from tidepool.operators.registry import mapping_upsert, registry_upsert
from tidepool.schema import HISTORY_SIZE
from tidepool.sources import decode as D
from tidepool.streaming import commits as C
from tidepool.streaming import tails as TL

ITEM = ("envelope_id long, device_id string, gateway_id string, data_type string, value double, ts timestamp, seq long, "
        "reject_reason string")
MEASUREMENTS, METRICS, REJECTS = "measurements", "metrics", "rejects"
DEVICES, GATEWAYS, MAPPINGS = "devices", "gateways", "mappings"
_SEEN = "last_seen timestamp, last_seq long"
REGISTRY_SCHEMAS = {
    DEVICES: f"device_id string, {_SEEN}", GATEWAYS: f"gateway_id string, {_SEEN}",
    MAPPINGS: "device_id string, gateway_id string, first_connected timestamp, first_seq long, last_connected timestamp, last_seq long"}


def decoded_items(envelopes: DataFrame) -> DataFrame:
    """``envelope_id, payload`` -> one row per item, group or envelope, with its reject reason if there is one."""
    items = D.parse_gateway_batch(envelopes.select("envelope_id", "payload"))
    place = F.shiftleft(F.coalesce(F.col("group_index"), F.lit(0)).cast("long"), 24) + F.coalesce(F.col("item_index"), F.lit(0))
    return items.select("envelope_id", "device_id", F.col("aggregator_id").alias("gateway_id"), "data_type", "value",
                        F.col("batch_time").alias("ts"), (F.shiftleft(F.col("envelope_id"), 31) + place).alias("seq"), "reject_reason")


def start_decoding(envelopes: DataFrame, items_path: str, checkpoint: str, available_now: bool = True):
    """Items of every envelope, once each (file sink with a commit log)."""
    w = decoded_items(envelopes).writeStream.format("parquet").option("path", items_path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def start_ingest(items: DataFrame, root: str, checkpoint: str, n: int = HISTORY_SIZE, available_now: bool = True):
    """All tables from decoded items; finite values enter the metrics (T11: others are stored without)."""
    good = F.col("reject_reason").isNull()
    finite = good & ~F.isnan("value") & (F.abs("value") < float("inf"))

    def tables(batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        new = batch.filter((F.col("_kind") == TL.NEW)).drop("_kind", "pool_sum", "pool_values")
        stored = new.filter(good)
        enters = batch.filter((F.col("_kind") == TL.OLD) | ((F.col("_kind") == TL.NEW) & F.coalesce(finite, F.lit(False))))
        m = M.rolling_metrics(TL.split_kinds(enters), n=n).filter(~F.col("_replay"))
        return {MEASUREMENTS: stored.drop("reject_reason"),
                METRICS: m.select("device_id", "data_type", "ts", "seq", F.col("value").alias("original_value"), "history_size", *M.METRIC_COLUMNS),
                REJECTS: new.filter(~good), DEVICES: registry_upsert(None, stored, ["device_id"]),
                GATEWAYS: registry_upsert(None, stored, ["gateway_id"]), MAPPINGS: mapping_upsert(None, stored)}

    return C.start_together(TL.with_tails(items, n - 1, kept=finite), root, checkpoint, tables, available_now)


def _merge(name: str) -> C.Merge:
    if name == MAPPINGS:
        return _merge_mappings
    ids = [REGISTRY_SCHEMAS[name].split()[0]]
    # rows already carry last_seen, last_seq: they merge as updates do
    return lambda df: registry_upsert(None, df.withColumnsRenamed({"last_seen": "ts", "last_seq": "seq"}), ids)


def _merge_mappings(df: DataFrame) -> DataFrame:
    return df.groupBy("device_id", "gateway_id").agg(
        F.min_by(F.struct("first_connected", "first_seq"), "first_seq").alias("_f"),
        F.max_by(F.struct("last_connected", "last_seq"), "last_seq").alias("_l")).select("device_id", "gateway_id", "_f.*", "_l.*")


def registry(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A registry as of the last commit."""
    return C.read_merged(spark, root, name, REGISTRY_SCHEMAS[name], _merge(name))


def fold_registry(spark: SparkSession, root: str, name: str) -> int:
    return C.fold(spark, root, name, REGISTRY_SCHEMAS[name], _merge(name))
