"""The last readings of every key in Spark's keyed state, and micro-batches through the batch plans.

For operators whose state is "the last values of each key" (rolling metrics: 99 values;
validation: the history of at most 100 kept values), a micro-batch gives the result of one
batch over all data if it is run together with what every key it touches held before:

    new readings  +  tails of their keys      ->  the skew-safe batch operator

The tails live in Spark's RocksDB state store through ``transformWithStateInPandas``: list state
with the last kept values, value state with the latest reading.  Checkpoints, versions and
recovery are Spark's.  The readings themselves do not pass through the state: they go beside it
(a union of both branches), and before the shuffle to the state every piece of a task's rows is
cut to the last ``n`` kept values and the latest reading of each key.  So a hot key
costs some hundred rows per piece, whatever its share, and no call holds its readings.

The batch side runs in ``foreachBatch`` and writes its tables under the batch's number
(``commits``).  Validation also needs the histories of *all* devices of a type, i.e. their sum
and number, one row per type: the state reports by how much each touched key's history changed,
and the table ``pools`` carries the totals on from batch to batch, as exact decimals, so they do
not drift and do not depend on the order of tasks.

NULL is a key like any other; readings without a time come first in their key.  Readings must
arrive in time order across micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidepool.operators import metrics as M
from tidepool.operators import validate as V
from tidepool.schema import HISTORY_SIZE
from tidepool.streaming import commits as C

KEYS = ("device_id", "data_type")
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_TIME = -(1 << 62)         # order of readings without a time
NEW, OLD, POOL = "new", "old", "pool"
POOLS, VALIDATED, METRICS = "pools", "validated", "metrics"
POOLS_SCHEMA = f"data_type string, pool_sum {V.EXACT}, pool_values long"

_ENTRY = "device_id string, data_type string, us long, seq long, value double, kept boolean"
_STATE_OUT = f"device_id string, data_type string, ts timestamp, seq long, value double, _kind string, pool_sum {V.EXACT}, pool_values long"


def _cut(n: int, keys: Sequence[str]):
    """Of each piece of rows the last ``n`` kept values and the latest reading of every key."""

    def run(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in pieces:
            piece = piece.sort_values(["us", "seq"], kind="mergesort", ignore_index=True)
            last = piece.groupby(list(keys), dropna=False, sort=False).tail(1).index
            kept = piece[piece["kept"]].groupby(list(keys), dropna=False, sort=False).tail(n).index
            yield piece.loc[last.union(kept)]
    return run


def _tail_state(n: int, eviction: bool):
    """State of one key.  Made inside a function, so that it goes to the workers by value.

    ``eviction``: a full history loses its oldest value to the next reading, kept or not, so
    after a reading that was not kept it holds one value less."""

    class Tail(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.tail = handle.getListState("tail", "us long, seq long, value double, exact string")
            self.last = handle.getValueState("last", "us long, seq long, kept boolean")

        @staticmethod
        def held(tail: list, last: tuple | None) -> list:
            short = eviction and last is not None and not last[2] and len(tail) == n
            return tail[1:] if short else tail

        @staticmethod
        def total(rows: list) -> Decimal:
            return sum((Decimal(t[3]) for t in rows), Decimal(0))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            tail = [tuple(t) for t in self.tail.get()] if self.tail.exists() else []
            last = tuple(self.last.get()) if self.last.exists() else None
            before = self.held(tail, last)
            for piece in rows:
                kept = piece[piece["kept"]]
                tail = tail + list(zip(kept["us"].tolist(), kept["seq"].tolist(), kept["value"].tolist(), kept["exact"].tolist()))
                tail = sorted(tail, key=lambda t: t[:2])[-n:]
                newest = max(zip(piece["us"].tolist(), piece["seq"].tolist(), piece["kept"].tolist()))
                last = newest if last is None or newest[:2] >= last[:2] else last
            after = self.held(tail, last)
            if tail:
                self.tail.put(tail)
            self.last.update(last)
            rows_out = [(t[0], t[1], t[2], "old", None, None) for t in before]
            rows_out.append((None, None, None, "pool", self.total(after) - self.total(before) if eviction else None, len(after) - len(before)))
            us, seq, value, kind, pool, number = zip(*rows_out)
            yield pd.DataFrame({
                "device_id": [key[0]] * len(us), "data_type": [key[1]] * len(us),
                "ts": pd.to_datetime(pd.Series([u if u is not None and u != NO_TIME else None for u in us], dtype="Int64"), unit="us"),
                "seq": pd.array(seq, "Int64"), "value": pd.array(value, "Float64"), "_kind": kind,
                "pool_sum": list(pool), "pool_values": pd.array(number, "Int64")})

        def close(self) -> None:
            pass

    return Tail()


def with_tails(readings: DataFrame, n: int, kept: Column | None = None, eviction: bool = False) -> DataFrame:
    """The readings of a stream (``device_id, data_type, ts, seq, value`` and more; ``_kind`` new), and
    in each micro-batch the tails of the keys it touches: what they held before (``old``), and by how much their sum
    and number change (``pool``).  ``kept`` says which readings enter the tail."""
    readings = readings.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("value", F.col("value").cast("double"))
    readings.sparkSession.conf.set(STORE, ROCKSDB)
    entries = readings.select(*KEYS, F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME)).alias("us"), "seq", "value",
                              F.coalesce(kept, F.lit(False)).alias("kept") if kept is not None else F.lit(True).alias("kept"))
    entries = entries.mapInPandas(_cut(n, KEYS), _ENTRY).withColumn("exact", V.exact(F.col("value")).cast("string"))
    tails = entries.groupBy(*KEYS).transformWithStateInPandas(_tail_state(n, eviction), _STATE_OUT, "Append", "None")
    return readings.withColumn("_kind", F.lit(NEW)).unionByName(tails, allowMissingColumns=True)


def split_kinds(batch: DataFrame) -> DataFrame:
    """New and old readings of a micro-batch, told apart by ``_replay``."""
    return batch.filter(F.col("_kind") != POOL).withColumn("_replay", F.col("_kind") == OLD).drop("_kind", "pool_sum", "pool_values")


# -- T3 ------------------------------------------------------------------------

def start_metrics_stream(readings: DataFrame, root: str, checkpoint: str, n: int = HISTORY_SIZE, available_now: bool = True, **options):
    """T3, skew-safe: rolling metrics over the last ``n`` values, in the table ``metrics``.
    Readings must be finite (T11)."""

    def tables(batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        m = M.rolling_metrics(split_kinds(batch), n=n, **options)
        return {METRICS: m.filter(~F.col("_replay")).drop("_replay")}

    return C.start_together(with_tails(readings, n - 1), root, checkpoint, tables, available_now)


# -- T4, T5 --------------------------------------------------------------------

def _kept_by(readings: DataFrame, rules) -> tuple[DataFrame, Column]:
    """Whether a reading enters the history, which the rules alone decide."""
    cleaned = V.clean_readings(readings, rules)
    return cleaned.select(*readings.columns, (~F.col("was_modified")).alias("_unmodified")), F.col("_unmodified")


def _validation_tails(readings: DataFrame, rules, history: int) -> DataFrame:
    marked, kept = _kept_by(readings, rules)
    return with_tails(marked, history, kept, eviction=True).drop("_unmodified")


def _pools_before(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    return C.read_committed(spark, root, POOLS, POOLS_SCHEMA, batch_id - 2, batch_id - 1).drop("stream_batch")


def _summed(*pools: DataFrame) -> DataFrame:
    rows = pools[0].select("data_type", "pool_sum", "pool_values")
    for p in pools[1:]:
        rows = rows.unionByName(p.select("data_type", "pool_sum", "pool_values"))
    return rows.groupBy("data_type").agg(F.sum("pool_sum").cast(V.EXACT).alias("pool_sum"), F.sum("pool_values").alias("pool_values"))


def start_validation_stream(readings: DataFrame, root: str, checkpoint: str, rules=None, history: int = HISTORY_SIZE,
                            available_now: bool = True, **options):
    """T4: ``validate_readings`` on a stream, in the table ``validated``; equal to one batch over all data."""
    held: list[DataFrame] = []

    def hold(rows: DataFrame) -> DataFrame:
        held.append(rows.persist())
        return held[-1]

    def let_go() -> None:
        while held:
            held.pop().unpersist()

    def tables(batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        before = _pools_before(batch.sparkSession, root, batch_id)
        # the pools without the keys at hand, whose histories are among the rows
        here = batch.filter(F.col("_kind") == OLD).select(
            "data_type", (-V.exact(F.col("value"))).alias("pool_sum"), F.lit(-1).cast("long").alias("pool_values"))
        v = V.validate_readings(split_kinds(batch), rules=rules, history=history, pool_offset=_summed(before, here), hold=hold, **options)
        return {VALIDATED: v.filter(~F.col("_replay")).drop("_replay"),
                POOLS: _summed(before, batch.filter(F.col("_kind") == POOL))}

    return C.start_together(_validation_tails(readings, rules, history), root, checkpoint, tables, available_now, let_go)


def start_pool_stream(readings: DataFrame, root: str, checkpoint: str, rules=None, history: int = HISTORY_SIZE, available_now: bool = True):
    """T5 alone: sum and number of the values in all current histories per type, in the table ``pools``."""

    def tables(batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        return {POOLS: _summed(_pools_before(batch.sparkSession, root, batch_id), batch.filter(F.col("_kind") == POOL))}

    return C.start_together(_validation_tails(readings, rules, history), root, checkpoint, tables, available_now)


def pool_averages(spark: SparkSession, root: str) -> DataFrame:
    """The average per type over the histories of all devices, as of the last batch."""
    last = C.last_commit(spark, root)
    pools = C.read_committed(spark, root, POOLS, POOLS_SCHEMA, last - 1, last).drop("stream_batch").filter("pool_values > 0")
    return pools.withColumn("type_average", F.col("pool_sum").cast("double") / F.col("pool_values"))
