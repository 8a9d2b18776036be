"""Skew-safe building blocks for per-key ordered computations.

The operators of this library are defined over the readings of one key
(device, type) in time order: "the last 100 values", "the number of valid
values before this row", "the running sum over all devices of a type".  A plain
``Window.partitionBy(key)`` puts every row of a key into one task, which breaks
down when one key holds a large share of the data.  The helpers here never
order a whole key inside one task:

``keyed_positions``
    0-based position of each row inside its key plus exclusive running sums, in
    two levels: a window over (key, time bucket) for the local part, and a tiny
    prefix sum over the per-bucket totals (pre-aggregated map-side) for the
    offsets.  The largest task holds one time bucket of one key.

``chunked_rolling``
    A ``ROWS BETWEEN n-1 PRECEDING AND CURRENT ROW`` window evaluated over
    fixed-size chunks of positions.  Each chunk also receives the last ``n-1``
    rows of the chunk before it (a halo), so every frame is complete while no
    task holds more than ``chunk_rows + n - 1`` rows.

No row is lost to a NULL: NULL is a key value like any other, and rows without a
time come first in their key.  Keys are packed into one struct, which is never
NULL itself, so joins on it stay plain equi-joins that reuse the window's hash
partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType
from pyspark.sql.window import WindowSpec

UNBOUNDED = Window.unboundedPreceding

# One hour of readings per (key, bucket) task by default; a hot key spreads
# over as many tasks as it has hours.
DEFAULT_BUCKET_SECONDS = 3600
# Rows per chunk of a sliding window (each chunk is one window partition).
DEFAULT_CHUNK_ROWS = 1 << 20
# Buckets of rows without a time: before (or, reversed, after) all others, by ranges of the
# second order column where that is a whole number.
NO_TIME = -(1 << 62)
NO_TIME_ROWS = 1 << 20


def time_bucket(time_col: str, bucket_seconds: int, within: Column | None = None) -> Column:
    """Bucket number of a timestamp column (floor of epoch / width); rows without a time are
    dealt by ranges of ``within``, a whole number that orders them."""
    micros = F.unix_micros(F.col(time_col).cast("timestamp"))
    untimed = F.lit(NO_TIME) if within is None else F.lit(NO_TIME) + F.coalesce(F.floor(within / F.lit(NO_TIME_ROWS)).cast("long"), F.lit(-(1 << 60)))
    return F.coalesce(F.floor(micros / F.lit(int(bucket_seconds) * 1_000_000)).cast("long"), untimed)


def _within(df: DataFrame, order: Sequence[str | Column]) -> Column | None:
    """The second order column, if it is a whole number."""
    name = order[1] if len(order) > 1 else None
    return F.col(name) if isinstance(name, str) and isinstance(df.schema[name].dataType, IntegralType) else None


def keyed_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    time_col: str = "ts",
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
    sums: Sequence[str] = (),
    index_col: str = "pos",
    total_col: str | None = None,
    bucket: Column | None = None,
    keep_first: int | None = None,
) -> DataFrame:
    """Add ``index_col`` (0-based position of the row in its key, ordered by
    ``order``), ``<s>_before`` for each column in ``sums`` (sum over the earlier
    rows of the key) and optionally ``total_col`` (rows in the key).

    ``order`` must start with ``time_col`` (or be monotone with ``bucket``) and
    be a total order inside the key.  ``keep_first`` drops, before the shuffle,
    rows that cannot be among the first k of their key (a plain row-number
    filter, which Spark turns into a group limit).
    """
    bkt = bucket if bucket is not None else time_bucket(time_col, bucket_seconds, _within(df, order))
    d = df.withColumn("_bkt", bkt).withColumn("_key", F.struct(*[F.col(k) for k in keys]))

    # Level 2 first: per (key, bucket) totals, partially aggregated map-side.
    tot_aggs = [F.count(F.lit(1)).alias("_bn")]
    tot_aggs += [F.sum(F.col(s)).alias(f"_bs_{s}") for s in sums]
    totals = d.groupBy("_key", "_bkt").agg(*tot_aggs)
    wb = Window.partitionBy("_key").orderBy("_bkt").rowsBetween(UNBOUNDED, -1)
    off_cols = [F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_off")]
    off_cols += [F.coalesce(F.sum(f"_bs_{s}").over(wb), F.lit(0)).alias(f"_os_{s}") for s in sums]
    if total_col:
        off_cols.append(F.sum("_bn").over(Window.partitionBy("_key")).alias(total_col))
    offsets = totals.select("_key", "_bkt", *off_cols)

    # Level 1: positions and running sums inside (key, bucket).
    w = Window.partitionBy("_key", "_bkt").orderBy(*order)
    wprev = w.rowsBetween(UNBOUNDED, -1)
    local = d.withColumn("_rn", F.row_number().over(w))
    if keep_first is not None:
        local = local.filter(F.col("_rn") <= F.lit(keep_first))
    for s in sums:
        local = local.withColumn(f"_ls_{s}", F.coalesce(F.sum(F.col(s)).over(wprev), F.lit(0)))

    out = local.join(offsets, on=["_key", "_bkt"], how="inner")
    out = out.withColumn(index_col, (F.col("_off") + F.col("_rn") - 1).cast("long"))
    for s in sums:
        parts = [F.col(f"_os_{s}"), F.col(f"_ls_{s}")]
        if isinstance(kind := df.schema[s].dataType, DecimalType):
            # one digit less, so that the sum keeps the scale
            parts = [p.cast(DecimalType(37, kind.scale)) for p in parts]
        out = out.withColumn(f"{s}_before", parts[0] + parts[1])
    drop = ["_key", "_bkt", "_rn", "_off"] + [f"_os_{s}" for s in sums] + [f"_ls_{s}" for s in sums]
    return out.drop(*drop)


def with_halo(df: DataFrame, index_col: str, n: int, chunk_rows: int) -> DataFrame:
    """The rows by chunks of ``chunk_rows`` positions: ``_chunk``, and ``_home``, which differs from it for the
    last ``n - 1`` rows of the chunk before."""
    if chunk_rows < n:
        raise ValueError("chunk_rows must be at least the frame length")
    pos = F.col(index_col)
    home = F.floor(pos / F.lit(chunk_rows)).cast("long")
    halo = (pos % F.lit(chunk_rows)) >= F.lit(chunk_rows - (n - 1))
    return (df.withColumn("_home", home)
              .withColumn("_chunk", F.explode(F.when(halo, F.array(home, home + 1))
                                               .otherwise(F.array(home)))))


def chunked_rolling(
    df: DataFrame,
    keys: Sequence[str],
    index_col: str,
    n: int,
    exprs: dict[str, Callable[[Callable[..., WindowSpec], Column], Column]],
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Evaluate sliding-frame aggregates over the last ``n`` rows of each key.

    ``index_col`` is a dense 0-based position inside the key (from
    ``keyed_positions``).  ``exprs`` maps an output name to a function
    ``(frame, x) -> Column``: ``frame(m=n)`` is the window spec over the last
    ``m <= n`` rows and ``x`` a double position usable as a regression abscissa
    (shift-invariant statistics only).
    """
    d = with_halo(df, index_col, n, chunk_rows)
    pos = F.col(index_col)
    base = Window.partitionBy(*keys, "_chunk").orderBy(index_col)

    def frame(m: int = n) -> WindowSpec:
        if not 1 <= m <= n:
            raise ValueError("frame length must be between 1 and n")
        return base.rowsBetween(-(m - 1), Window.currentRow)

    x = (pos - F.col("_chunk") * F.lit(chunk_rows)).cast("double")
    cols = [fn(frame, x).alias(name) for name, fn in exprs.items()]
    return (d.select("*", *cols)
             .filter(F.col("_chunk") == F.col("_home"))
             .drop("_chunk", "_home"))


def last_k_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    k: int,
    time_col: str = "ts",
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
    rank_col: str = "recency_rank",
) -> DataFrame:
    """Keep the last ``k`` rows of each key (top-k per group) without ordering a
    whole key in one task: the first ``k`` in reversed order; ``rank_col`` is 1
    for the newest row."""
    newest = [(F.col(c) if isinstance(c, str) else c).desc() for c in order]
    p = keyed_positions(df, keys, newest, time_col, index_col="_p", keep_first=k,
                        bucket=-time_bucket(time_col, bucket_seconds, _within(df, order)))
    return (p.filter(F.col("_p") < F.lit(k))
             .withColumn(rank_col, (F.col("_p") + 1).cast("long"))
             .drop("_p"))


def first_k_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    k: int,
    time_col: str = "ts",
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
    rank_col: str = "rank",
    total_col: str = "group_rows",
) -> DataFrame:
    """Keep the first ``k`` rows of each key, with the key's row count."""
    p = keyed_positions(df, keys, order, time_col, bucket_seconds,
                        index_col="_p", total_col=total_col, keep_first=k)
    return (p.filter(F.col("_p") < F.lit(k))
             .withColumn(rank_col, (F.col("_p") + 1).cast("long"))
             .drop("_p"))
