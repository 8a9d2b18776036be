"""Validation and cleaning of readings.

Per reading, in (ts, seq) order inside its (device, type):

1. Range rule of its type (types without a rule are unbounded): below the
   minimum -> set to the minimum, above the maximum -> set to the maximum.
2. NaN or +/-Infinity -> replaced by the average of the *current histories of
   all devices* for that type (0.0 when there is none); this overrides step 1.
3. History: only unmodified values are kept, at most 100 per key; when the
   history holds 100 values the oldest is evicted before the reading is
   considered, even if the reading is modified and not kept.  So the history a
   reading sees has ``k = c`` values while ``c`` (unmodified readings before
   it) is below 100, else 100 if the previous reading of the key was
   unmodified and 99 if it was modified.
4. Anomaly: with ``k >= 5`` values, flag when ``|value - mean| > 3 sigma``
   (population sigma, raw value, history before the reading; NaN never flags).

Plan (no per-key window):

* ``keyed_positions`` gives each reading its position ``pos`` and ``c``;
* the unmodified readings, indexed by ``c``, get sliding 100- and 99-frame
  statistics (``history_snapshots``: chunks of a key, whose frames are added up side by side in
  NumPy, value by value in the order of Spark's own aggregates) -- the history snapshot after each kept value;
* each reading joins the snapshot at index ``c - 1`` (equi join on key and
  index, so a hot key spreads over tasks): ``k``, mean, sigma and the value an
  eviction removes;
* the cross-device average is a per-type running sum of signed deltas
  (+value kept, -value evicted), again through ``keyed_positions``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.scalar import fixed2, is_nonfinite, plain_number_text
from tidepool.plans.windows import (DEFAULT_BUCKET_SECONDS, DEFAULT_CHUNK_ROWS,
                                    keyed_positions, last_k_per_key, with_halo)
from tidepool.schema import (ANOMALY_SIGMAS, DEFAULT_RULES, HISTORY_SIZE, MIN_ANOMALY_HISTORY,
                             MSG_ABOVE, MSG_ANOMALY, MSG_BELOW, MSG_NONFINITE, MSG_VALID,
                             STATUS_INVALID, STATUS_OK, STATUS_PARTIAL)

KEYS = ("device_id", "data_type")
ORDER = ("ts", "seq")
TYPE_BUCKET_SECONDS = 60
# Sums of values over devices: whole multiples of 1e-15, so that they are exact and do not
# depend on the order of rows.  Values of 1e22 and more in size add nothing to them.
EXACT_SCALE = 15
EXACT = f"decimal(37,{EXACT_SCALE})"
LARGEST = 1e22


def exact(c: Column) -> Column:
    return F.when(F.abs(c) < LARGEST, c.cast(EXACT)).otherwise(F.lit(0).cast(EXACT))


def attach_rules(df: DataFrame, rules=None, type_col: str = "data_type") -> DataFrame:
    """Add ``min_value``/``max_value`` of the reading's type; NULL bounds
    (unbounded) when the type has no rule.

    ``rules`` is a list of ``(type, min, max)`` (inlined as a map literal: no
    join at all) or a DataFrame ``(data_type, min_value, max_value)`` (left
    join, for which Spark picks the strategy from its size)."""
    if rules is None:
        rules = DEFAULT_RULES
    if isinstance(rules, DataFrame):
        r = rules.select(F.col("data_type").alias("_rt"), "min_value", "max_value")
        return (df.join(r, F.col(type_col) == F.col("_rt"), "left").drop("_rt"))
    if not rules:
        return df.withColumn("min_value", F.lit(None).cast("double")).withColumn("max_value", F.lit(None).cast("double"))
    lo = F.create_map(*[x for t, a, _ in rules for x in (F.lit(t), F.lit(float(a)))])
    hi = F.create_map(*[x for t, _, b in rules for x in (F.lit(t), F.lit(float(b)))])
    return (df.withColumn("min_value", lo[F.col(type_col)])
              .withColumn("max_value", hi[F.col(type_col)]))


def clean_readings(df: DataFrame, rules=None, value: str = "value",
                   type_col: str = "data_type") -> DataFrame:
    """J3 + P9 + P11 (row-local part): ``cleaned_value`` (clamped; NULL for
    non-finite readings, whose replacement needs history), ``was_modified``,
    ``validation_message``, ``nonfinite``."""
    d = attach_rules(df, rules, type_col)
    v = F.col(value)
    lo, hi = F.col("min_value"), F.col("max_value")
    nonfinite = is_nonfinite(v)
    below = ~nonfinite & lo.isNotNull() & (v < lo)
    above = ~nonfinite & hi.isNotNull() & (v > hi)
    msg = (F.when(nonfinite, F.lit(MSG_NONFINITE))
            .when(below, F.format_string(MSG_BELOW.replace("{}", "%s"), plain_number_text(lo)))
            .when(above, F.format_string(MSG_ABOVE.replace("{}", "%s"), plain_number_text(hi)))
            .otherwise(F.lit(MSG_VALID)))
    cleaned = (F.when(nonfinite, F.lit(None).cast("double"))
                .when(below, lo).when(above, hi).otherwise(v))
    return (d.withColumn("nonfinite", F.coalesce(nonfinite, F.lit(False)))
             .withColumn("was_modified", F.coalesce(nonfinite | below | above, F.lit(False)))
             .withColumn("validation_message", msg)
             .withColumn("cleaned_value", cleaned))


FRAME_ROWS = 8_192           # frames added up side by side


def _snapshots(keys: Sequence[str], history: int):
    """Of one chunk.  Made inside a function, so that it goes to the workers by value."""
    keys, block = list(keys), FRAME_ROWS

    def frames(x: np.ndarray, there: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, mean and deviation of the last ``n`` values at each row, oldest first: sum over number and Welford's
        steps, as ``avg`` and ``stddev_pop`` take them, so the digits are theirs."""
        x, there = np.concatenate([np.zeros(n - 1), x]), np.concatenate([np.zeros(n - 1, bool), there])
        size, mean, deviation = (np.zeros(len(x) - n + 1) for _ in range(3))
        for at in range(0, len(size), block):
            rows = min(block, len(size) - at)
            number, total, middle, squares = (np.zeros(rows) for _ in range(4))
            for i in range(at, at + n):
                v, here = x[i:i + rows], there[i:i + rows]
                number = number + here
                total += v
                delta = np.where(here, v - middle, 0.0)
                step = delta / np.maximum(number, 1.0)
                middle += step
                squares += delta * (delta - step)
            part = slice(at, at + rows)
            size[part], mean[part], deviation[part] = number, total / np.maximum(number, 1.0), np.sqrt(squares / np.maximum(number, 1.0))
        return size, mean, deviation

    def run(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("_u").combine_chunks()
        value = chunk["_hv"]
        there = value.is_valid().to_numpy()
        x = np.where(there, value.fill_null(0.0).to_numpy(), 0.0)
        at = np.arange(len(x))
        oldest = np.maximum(at - (history - 1), 0)
        out = {c: chunk[c] for c in (*keys, "_u", "_snap_pos")}
        with np.errstate(all="ignore"):
            for name, n in (("full", history), ("short", history - 1)):
                size, mean, deviation = frames(x, there, n)
                out[f"_m_{name}"] = pa.array(mean, mask=size == 0)
                out[f"_s_{name}"] = pa.array(deviation, mask=size == 0)
        out["_oldest"] = pa.array(x[oldest], mask=~there[oldest])
        return pa.table(out).filter(pa.array((chunk["_home"].to_numpy() == chunk["_chunk"].to_numpy())))

    return run


def history_snapshots(kept: DataFrame, keys: Sequence[str], history: int, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Mean, deviation and first value of the last ``history`` (``full``) and ``history - 1`` (``short``) values up to each kept value.

    ``kept`` has the keys, ``_u`` (dense position in the key), ``_snap_pos`` and ``_hv``, the value."""
    if history < 2:
        raise ValueError("a history must hold two values at least")
    chunks = with_halo(kept.withColumn("_hv", F.col("_hv").cast("double")), "_u", history, chunk_rows)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keys, "_u", "_snap_pos").schema.fields]
    stats = [f"{c} double" for c in ("_m_full", "_s_full", "_m_short", "_s_short", "_oldest")]
    return chunks.groupBy(*keys, "_chunk").applyInArrow(_snapshots(keys, history), ", ".join(fields + stats))


def history_statistics(
    df: DataFrame,
    rules=None,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    value: str = "value",
    time_col: str = "ts",
    history: int = HISTORY_SIZE,
    min_history: int = MIN_ANOMALY_HISTORY,
    sigmas: float = ANOMALY_SIGMAS,
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
    bucket: Column | None = None,
) -> DataFrame:
    """Cleaning, history statistics, anomaly flag and the signed pool deltas
    ``_dsum``/``_dn`` of each reading (what it adds to / evicts from the
    history pool of its type).  ``bucket`` as in ``keyed_positions``."""
    type_col = keys[-1]
    base = clean_readings(df, rules, value, type_col)
    base = base.withColumn("_keep", (~F.col("was_modified")).cast("long"))
    pos = keyed_positions(base, keys, order, time_col, bucket_seconds,
                          sums=["_keep"], index_col="_pos", bucket=bucket)
    pos = pos.withColumnRenamed("_keep_before", "_c")

    # History snapshots: after each kept value, stats of the last 100 / 99 kept.
    v = F.col(value)
    kept = pos.filter(F.col("_keep") == 1).select(*keys, F.col("_c").alias("_u"),
                                                   F.col("_pos").alias("_snap_pos"), v.alias("_hv"))
    snaps = history_snapshots(kept, keys, history, chunk_rows)

    j = _join_snapshot(pos, snaps, keys)
    c = F.col("_c")
    prev_kept = F.col("_snap_pos") == F.col("_pos") - 1
    k = (F.when(c < history, c)
          .when(prev_kept, F.lit(history))
          .otherwise(F.lit(history - 1)))
    full = k == F.lit(history)
    short = (c >= history) & ~prev_kept
    mean = F.when(k == 0, F.lit(None)).when(short, F.col("_m_short")).otherwise(F.col("_m_full"))
    std = F.when(k == 0, F.lit(None)).when(short, F.col("_s_short")).otherwise(F.col("_s_full"))
    j = (j.withColumn("history_size", k.cast("long"))
          .withColumn("history_mean", mean.cast("double"))
          .withColumn("history_std", std.cast("double")))
    anomalous = ((F.col("history_size") >= min_history) & ~F.isnan(v) &
                 (F.abs(v - F.col("history_mean")) > F.lit(sigmas) * F.col("history_std")))
    j = (j.withColumn("is_anomaly", F.coalesce(anomalous, F.lit(False)))
          .withColumn("anomaly_message",
                      F.when(F.col("is_anomaly"),
                             F.format_string(MSG_ANOMALY.replace("{}", "%s"),
                                             fixed2("history_mean"), fixed2("history_std")))))

    # Live cross-device average per type: signed deltas of the history pool.
    keep = F.col("_keep") == 1
    evict = full
    zero = F.lit(0).cast(EXACT)
    j = (j.withColumn("_dsum", (F.when(keep, exact(v)).otherwise(zero) -
                                F.when(evict, exact(F.col("_oldest"))).otherwise(zero)).cast(EXACT))
          .withColumn("_dn", keep.cast("long") - evict.cast("long")))
    drop = ["_pos", "_u", "_snap_pos", "_m_full", "_s_full", "_m_short",
            "_s_short", "_oldest", "_keep", "_c"]
    return j.drop(*drop)


def validate_readings(
    df: DataFrame,
    rules=None,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    value: str = "value",
    time_col: str = "ts",
    history: int = HISTORY_SIZE,
    min_history: int = MIN_ANOMALY_HISTORY,
    sigmas: float = ANOMALY_SIGMAS,
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
    pool_offset: DataFrame | None = None,
    bucket: Column | None = None,
    hold: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """U2 per reading: cleaning (P9-P11), valid-only history statistics (W7),
    the 3-sigma flag (W8, P12) and non-finite replacement by the live
    cross-device average (W9, P10).

    Adds ``original_value``, ``cleaned_value``, ``was_modified``,
    ``validation_message``, ``history_size``, ``history_mean``,
    ``history_std``, ``is_anomaly``, ``anomaly_message``, ``type_average``
    (average of the type's pool before the reading).

    ``pool_offset`` ``(data_type, pool_sum, pool_values)`` adds histories that
    are not among the input rows (devices without readings in an incremental
    run) to the cross-device pool; it has one row per type.

    The readings with their statistics are read twice, for the pool's totals and for its running
    sums: ``hold`` may return them kept (``DataFrame.persist``), for a caller that can let them go."""
    type_col = keys[-1]
    v = F.col(value)
    j = history_statistics(df, rules, keys, order, value, time_col, history, min_history, sigmas,
                      bucket_seconds, chunk_rows, bucket)
    j = j if hold is None else hold(j)
    # all devices of a type share a bucket here: a narrow one keeps the task small
    typed = keyed_positions(j, [type_col], order, time_col, min(bucket_seconds, TYPE_BUCKET_SECONDS),
                            sums=["_dsum", "_dn"], index_col="_tpos")
    if pool_offset is not None:
        off = pool_offset.select(F.col(type_col).alias("_otype"), F.col("pool_sum").alias("_osum"),
                                 F.col("pool_values").alias("_on"))
        typed = (typed.join(off, F.col(type_col).eqNullSafe(F.col("_otype")), "left").drop("_otype")
                      .withColumn("_dsum_before", F.col("_dsum_before").cast(EXACT) + F.coalesce("_osum", F.lit(0).cast(EXACT)))
                      .withColumn("_dn_before", F.col("_dn_before") + F.coalesce("_on", F.lit(0)))
                      .drop("_osum", "_on"))
    avg = F.when(F.col("_dn_before") > 0, F.col("_dsum_before").cast("double") / F.col("_dn_before"))
    out = (typed.withColumn("type_average", avg)
                .withColumn("original_value", v)
                .withColumn("cleaned_value",
                            F.when(F.col("nonfinite"), F.coalesce(F.col("type_average"), F.lit(0.0)))
                             .otherwise(F.col("cleaned_value"))))
    return out.drop("_dsum", "_dn", "_tpos", "_dsum_before", "_dn_before")


def _join_snapshot(pos: DataFrame, snaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each reading with the snapshot taken after the last kept value before
    it (kept index ``c - 1``)."""
    key = F.struct(*[F.col(k) for k in keys])   # never NULL itself: NULL keys find their snapshots too
    s = (snaps.withColumn("_snap_key", key).withColumn("_snap_at", F.col("_u") + 1)
              .drop(*keys, "_u"))
    p = pos.withColumn("_pos_key", key)
    out = p.join(s, on=[p["_pos_key"] == s["_snap_key"], p["_c"] == s["_snap_at"]], how="left")
    return out.drop("_pos_key", "_snap_key", "_snap_at")


def batch_status(validated: DataFrame, batch_cols: Sequence[str],
                 item_col: str | None = "data_type") -> DataFrame:
    """A6 + A7: one row per batch with item / modified counts and the status.
    Batches whose items are all NULL (an ``explode_outer`` of an empty list)
    count zero items and are INVALID."""
    item = F.col(item_col).isNotNull() if item_col else F.lit(True)
    g = validated.groupBy(*batch_cols).agg(
        F.count_if(item).alias("total_items"),
        F.count_if(item & F.coalesce(F.col("was_modified"), F.lit(False))).alias("modified_items"))
    status = (F.when(F.col("total_items") == 0, F.lit(STATUS_INVALID[0]))
               .when(F.col("modified_items") > 0, F.lit(STATUS_PARTIAL[0]))
               .otherwise(F.lit(STATUS_OK[0])))
    code = (F.when(F.col("total_items") == 0, F.lit(STATUS_INVALID[1]))
             .when(F.col("modified_items") > 0, F.lit(STATUS_PARTIAL[1]))
             .otherwise(F.lit(STATUS_OK[1])))
    msg = (F.when(F.col("total_items") == 0, F.lit(STATUS_INVALID[2]))
            .when(F.col("modified_items") > 0, F.lit(STATUS_PARTIAL[2]))
            .otherwise(F.lit(STATUS_OK[2])))
    return (g.withColumn("status", status).withColumn("status_code", code.cast("int"))
             .withColumn("status_message", msg))


def drop_invalid_batches(validated: DataFrame, status: DataFrame,
                         batch_cols: Sequence[str]) -> DataFrame:
    """keep the readings of batches whose status is not INVALID."""
    # NULL is a batch like any other
    ok = status.filter(F.col("status") != F.lit(STATUS_INVALID[0])).select(F.struct(*batch_cols).alias("_ok"))
    return validated.join(ok, F.struct(*[F.col(c) for c in batch_cols]) == F.col("_ok"), "left_semi")


def end_histories(df: DataFrame, rules=None, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, value: str = "value",
                  time_col: str = "ts", history: int = HISTORY_SIZE, bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """The history of every key after its last reading: its last ``history`` kept values, one less if it is
    full and the last reading was not kept (which evicted a value).  Only the last kept values of a key and whether its
    last reading was kept matter, so no frame slides over the readings."""
    base = clean_readings(df, rules, value, keys[-1]).withColumn("_keep", ~F.col("was_modified"))
    key = F.struct(*[F.col(k) for k in keys])             # NULL is a key like any other
    last = base.groupBy(key.alias("_end_key")).agg(F.max_by("_keep", F.struct(*order)).alias("_last"), F.count_if("_keep").alias("_kept"))
    size = F.when((F.col("_kept") >= history) & ~F.col("_last"), F.lit(history - 1)).otherwise(F.lit(history))
    tails = last_k_per_key(base.filter("_keep").select(*df.columns), keys, order, history, time_col, bucket_seconds, rank_col="_rank")
    ends = last.select("_end_key", size.alias("_size"))
    return tails.join(ends, key == F.col("_end_key")).filter(F.col("_rank") <= F.col("_size")).drop("_rank", "_size", "_end_key")


def type_averages(df: DataFrame, rules=None, keys: Sequence[str] = KEYS, value: str = "value", **kw) -> DataFrame:
    """Average per type over the union of all devices' current
    (end-state) histories; the sums are exact (``exact``)."""
    g = end_histories(df, rules, keys, value=value, **kw).groupBy(keys[-1]).agg(
        F.sum(exact(F.col(value))).cast(EXACT).alias("pool_sum"), F.count(F.lit(1)).alias("pool_values"))
    return g.withColumn("type_average", F.col("pool_sum").cast("double") / F.col("pool_values"))
