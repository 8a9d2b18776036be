"""Keyed state for the live paths: T3 rolling metrics (state = the last
``n`` values of a (device, type)) and T6/T7 presence with an inactivity
timer (state = last-seen time of a device).

Both use ``applyInPandasWithState``: Spark shuffles by key, keeps the state
in its checkpointed state store, and hands each group's rows of a micro-batch
to the function as Arrow batches.  State per key is bounded (``n`` doubles,
one long); the rows of a group in one call are bounded by the micro-batch
size (``maxFilesPerTrigger`` / ``maxOffsetsPerTrigger``).  The per-row work
is vectorised with NumPy over the group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidepool.schema import HISTORY_SIZE, INACTIVITY_HOURS

METRICS_OUT = ("device_id string, data_type string, seq long, ts timestamp, original_value double, "
               "history_size long, average_value double, variance double, std_dev double, "
               "trend_coefficient double, normalized_value double, anomaly_score double")
METRICS_STATE = "history array<double>"


def _metrics_fn(n: int):
    """The state function.  Everything it calls is defined inside this
    factory, so it is shipped to the Python workers by value and needs no
    import of this package there."""

    def window_metrics(hist: np.ndarray, vals: np.ndarray) -> dict:
        """Metrics of each new value over the last ``n`` values including
        it, given the previous history ``hist`` (oldest first)."""
        arr = np.concatenate([hist, vals])
        pad = np.concatenate([np.zeros(n - 1), arr])
        win = np.lib.stride_tricks.sliding_window_view(pad, n)[len(hist):]      # (m, n)
        cnt = np.minimum(np.arange(len(hist) + 1, len(arr) + 1), n)             # values per window
        mask = np.arange(n)[None, :] >= (n - cnt)[:, None]
        mean = np.where(mask, win, 0.0).sum(1) / cnt
        dev = np.where(mask, win - mean[:, None], 0.0)
        var = np.where(cnt > 1, (dev * dev).sum(1) / cnt, 0.0)
        x = np.arange(n)[None, :] - (n - cnt)[:, None]
        xd = np.where(mask, x - ((cnt - 1) / 2.0)[:, None], 0.0)
        sxx = (xd * xd).sum(1)
        slope = np.where(cnt > 2, (xd * dev).sum(1) / np.where(sxx > 0, sxx, 1.0), 0.0)
        std = np.sqrt(var)
        z = np.where((cnt > 1) & (var > 0), (vals - mean) / np.where(std > 0, std, 1.0), 0.0)
        return {"history_size": cnt.astype("int64"), "average_value": mean, "variance": var,
                "std_dev": std, "trend_coefficient": slope, "normalized_value": z,
                "anomaly_score": np.abs(z)}

    def fn(key, pdfs, state):
        frames = [p for p in pdfs if len(p)]
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True)
        # rows of one trigger may arrive in several Arrow chunks: order first
        pdf = pdf.sort_values(["ts", "seq"], kind="mergesort").reset_index(drop=True)
        hist = np.asarray(state.get[0] if state.exists else [], dtype="float64")
        vals = pdf["value"].to_numpy(dtype="float64")
        m = window_metrics(hist, vals)
        state.update((np.concatenate([hist, vals])[-n:].tolist(),))
        yield pd.DataFrame({"device_id": pdf["device_id"], "data_type": pdf["data_type"],
                            "seq": pdf["seq"].astype("int64"), "ts": pdf["ts"], "original_value": vals, **m})
    return fn


def stream_rolling_metrics(readings: DataFrame, n: int = HISTORY_SIZE,
                           keys: Sequence[str] = ("device_id", "data_type")) -> DataFrame:
    """U1 on a stream; same columns as the batch ``rolling_metrics``.
    Input rows must be finite (route others around, T11) and arrive in time
    order across micro-batches."""
    r = readings.select(*keys, "seq", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double"))
    return r.groupBy(*keys).applyInPandasWithState(
        _metrics_fn(n), METRICS_OUT, METRICS_STATE, "append", GroupStateTimeout.NoTimeout)


INACTIVE_OUT = "device_id string, inactive_since timestamp, detected_by string"
INACTIVE_STATE = "last_us long"


def _inactivity_fn(hours: float):
    gap_us = int(hours * 3600 * 1_000_000)

    def fn(key, pdfs: Iterator[pd.DataFrame], state):
        dev = key[0]
        if state.hasTimedOut:
            last_us = state.get[0]
            state.remove()
            yield pd.DataFrame({"device_id": [dev], "inactive_since": [pd.Timestamp(last_us, unit="us")],
                                "detected_by": ["timer"]})
            return
        frames = [p for p in pdfs if len(p)]
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True).sort_values(["ts", "seq"], kind="mergesort")
        ts_us = pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        prev = state.get[0] if state.exists else None
        seq = ts_us if prev is None else np.concatenate([[prev], ts_us])
        seq = np.maximum.accumulate(seq)     # a late reading never moves last-seen back
        gaps = np.nonzero(np.diff(seq) > gap_us)[0]
        since = seq[gaps]
        last = int(seq[-1])
        rows = [(dev, int(s), "gap") for s in since]
        timeout_ms = last // 1000 + gap_us // 1000
        if timeout_ms < state.getCurrentWatermarkMs():
            # already past the threshold (this key's data was late in the trigger)
            rows.append((dev, last, "timer"))
            state.remove()
        else:
            state.update((last,))
            state.setTimeoutTimestamp(timeout_ms)
        if rows:
            yield pd.DataFrame({"device_id": [r[0] for r in rows],
                                "inactive_since": pd.to_datetime([r[1] for r in rows], unit="us"),
                                "detected_by": [r[2] for r in rows]})
    return fn


def _first_and_last(hours: float):
    """Of each piece of rows the first and the last time of every device in every stretch of ``hours``: between
    them no silence is longer than that, so nothing else matters."""
    width = int(hours * 3600 * 1_000_000)

    def run(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in pieces:
            piece = piece.reset_index(drop=True)
            stretch = piece["ts"].astype("datetime64[us, UTC]" if piece["ts"].dt.tz is not None else "datetime64[us]").astype("int64") // width
            times = piece.groupby([piece["device_id"], stretch], dropna=False, sort=False)["ts"]
            yield piece.loc[times.idxmin().to_list() + times.idxmax().to_list()]
    return run


def stream_inactivity(readings: DataFrame, hours: float = INACTIVITY_HOURS, watermark: str = "1 minute",
                      device: str = "device_id") -> DataFrame:
    """One row per inactivity period of a device (``inactive_since`` =
    its last reading before the silence).  A period is reported once: by the
    event-time timer when the watermark passes ``last seen + hours``, or on
    the next reading when that comes more than ``hours`` later.  Before the shuffle a
    device's readings are cut to two per stretch of ``hours`` and piece of rows, so a hot device costs
    little.  Readings without a time say nothing about a silence."""
    r = readings.select(F.col(device).alias("device_id"), "seq", F.col("ts").cast("timestamp").alias("ts")).filter("ts IS NOT NULL")
    r = r.mapInPandas(_first_and_last(hours), r.schema).withWatermark("ts", watermark)
    return r.groupBy("device_id").applyInPandasWithState(
        _inactivity_fn(hours), INACTIVE_OUT, INACTIVE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
