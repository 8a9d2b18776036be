"""T1 as outgoing batches: every flush window of a gateway leaves once, as one envelope.

Readings of open windows lie in Spark's keyed state (``transformWithStateInPandas``: list state, on
RocksDB).  An event-time timer at the end of a span's earliest open window sends all its windows that the
watermark, the newest time less the allowed ``delay``, has passed, and drops them from the state.  A reading that
comes after that leaves at once, in an envelope of its own window marked ``late``; none is lost.
A marker row, later than all readings by more than interval and delay, moves the watermark past
every open window: written at the end of the input, it flushes them.

State, timers and calls are by gateway and span, ``SPAN`` intervals: a call holds one gateway's readings of one
span, not of a whole trigger, whatever piles up there.  An envelope is one message, so its size is the gateway's
rate times the interval, as in the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidepool.schema import DATA_FIELD, GATEWAY_FIELD, GATEWAY_FLUSH, ID_FIELD, TYPE_FIELD, UNKNOWN_ID, VALUE_FIELD
from tidepool.streaming.tails import ROCKSDB, STORE

SPAN = 120                    # windows of a gateway that share one state; with 30 s, an hour

_WINDOW = "items array<struct<data_type:string,us:bigint,seq:bigint,value:double,device:string>>"
_OPEN = "start long, data_type string, us long, seq long, value double, device string"
_OUT = f"gateway_id string, flush_start timestamp, late boolean, {_WINDOW}"


def _windows(interval_us: int):
    """State of one gateway's span.  Made inside a function, so that it goes to the workers by value."""

    class Windows(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.open = handle.getListState("open", _OPEN)

        @staticmethod
        def _out(gateway, envelopes: list[tuple[int, bool, list]]) -> pd.DataFrame:
            return pd.DataFrame({
                "gateway_id": pd.Series([gateway] * len(envelopes), dtype=object), "flush_start": pd.to_datetime([e[0] for e in envelopes], unit="us"),
                "late": pd.array([e[1] for e in envelopes], "boolean"),
                "items": [[dict(zip(("data_type", "us", "seq", "value", "device"), i)) for i in e[2]] for e in envelopes]})

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            watermark = timerValues.getCurrentWatermarkInMs() * 1000
            windows: dict[int, list] = {}
            for piece in rows:
                piece = piece[~piece["marker"]]
                start = piece["us"] - piece["us"] % interval_us
                for s, *item in zip(start.tolist(), piece["data_type"], piece["us"].tolist(), piece["seq"].tolist(), piece["value"].tolist(), piece["device"]):
                    windows.setdefault(s, []).append(tuple(item))
            late = [(s, True, items) for s, items in sorted(windows.items()) if s + interval_us <= watermark]
            waits = [(s, *i) for s, items in windows.items() if s + interval_us > watermark for i in items]
            if waits:
                self.open.appendList(waits)
                self.handle.registerTimer((min(w[0] for w in waits) + interval_us) // 1000)
            if late:
                yield self._out(key[0], late)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            watermark = timerValues.getCurrentWatermarkInMs() * 1000
            rows = [tuple(r) for r in self.open.get()] if self.open.exists() else []
            done: dict[int, list] = {}
            for s, *item in rows:
                if s + interval_us <= watermark:
                    done.setdefault(s, []).append(tuple(item))
            if done:
                waits = [r for r in rows if r[0] not in done]
                if waits:
                    self.open.put(waits)
                    self.handle.registerTimer((min(w[0] for w in waits) + interval_us) // 1000)
                else:
                    self.open.clear()
                yield self._out(key[0], [(s, False, items) for s, items in sorted(done.items())])

        def close(self) -> None:
            pass

    return Windows()


def stream_envelopes(readings: DataFrame, interval_seconds: int | None = None, delay: str = "1 minute") -> DataFrame:
    """``AggregatorId, flush_start, late, Data`` as ``batch_envelopes`` gives them, each window once.
    ``readings`` may hold marker rows (``flush_marker``); readings without a time are left out, as in the batch form."""
    seconds = int(GATEWAY_FLUSH.split()[0]) if interval_seconds is None else interval_seconds
    interval_us = seconds * 1_000_000
    readings.sparkSession.conf.set(STORE, ROCKSDB)
    marker = F.coalesce(F.col("marker"), F.lit(False)) if "marker" in readings.columns else F.lit(False)
    rows = readings.withColumn("ts", F.col("ts").cast("timestamp")).filter("ts IS NOT NULL").withWatermark("ts", delay)
    # the state decides what is late, so the time goes there as a number
    rows = rows.select("gateway_id", "data_type", F.unix_micros("ts").alias("us"), "seq", F.col("value").cast("double").alias("value"),
                       F.coalesce(F.col("device_id"), F.lit(UNKNOWN_ID)).alias("device"), marker.alias("marker"))
    rows = rows.withColumn("span", F.col("us") - F.pmod(F.col("us"), F.lit(SPAN * interval_us)))
    sent = rows.groupBy("gateway_id", "span").transformWithStateInPandas(_windows(interval_us), _OUT, "Append", "EventTime")
    types = F.array_sort(F.array_distinct(F.transform("items", lambda i: i["data_type"])))

    def group(t):
        own = F.array_sort(F.transform(F.filter("items", lambda i: i["data_type"].eqNullSafe(t)), lambda i: F.struct(
            i["us"].alias("t"), i["seq"].alias("s"), i["value"].alias(VALUE_FIELD), i["device"].alias(ID_FIELD))))
        data = F.transform(own, lambda i: F.struct(i[VALUE_FIELD].alias(VALUE_FIELD), i[ID_FIELD].alias(ID_FIELD)))
        return F.struct(t.alias(TYPE_FIELD), data.alias(DATA_FIELD))

    return sent.select(F.col("gateway_id").alias(GATEWAY_FIELD), "flush_start", "late", F.transform(types, group).alias(DATA_FIELD))


def flush_marker(spark: SparkSession, schema, newest, ahead: str = "1 day") -> DataFrame:
    """One row that flushes all windows up to ``newest``; ``ahead`` must exceed interval and delay."""
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in ("ts", "marker")]
    return spark.range(1).select(*columns, (F.lit(newest).cast("timestamp") + F.expr(f"INTERVAL {ahead}")).alias("ts"), F.lit(True).alias("marker"))
