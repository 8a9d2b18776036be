"""Column-level helpers (all built-in Spark expressions, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def evaluated_once(df, exprs: dict):
    """Add computed columns as the output of a generator.  Later filters on
    them cannot be pushed below it (the optimizer pushes predicates through
    projections by re-inlining the expression), so an expensive decode runs
    once per row instead of once per predicate and projection."""
    packed = F.struct(*[e.alias(n) for n, e in exprs.items()])
    return df.select("*", F.inline(F.array(packed)))


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_nonfinite(c: str | Column) -> Column:
    """NaN or +/-Infinity (NULL stays NULL)."""
    c = col(c)
    return F.isnan(c) | (F.abs(c) == F.lit(INF))


def plain_number_text(c: str | Column) -> Column:
    """Render a double the way a shortest-form formatter prints it without a
    forced decimal part: ``-10.0`` -> ``-10``, ``0.5`` -> ``0.5``, ``inf`` ->
    ``inf``.  Used for the bounds inside validation messages."""
    c = col(c)
    integral = (F.floor(c) == c) & (F.abs(c) < F.lit(1e15))
    return (F.when(F.isnan(c), F.lit("NaN"))
             .when(c == F.lit(INF), F.lit("inf"))
             .when(c == F.lit(-INF), F.lit("-inf"))
             .when(integral, c.cast("decimal(20,0)").cast("string"))
             .otherwise(c.cast("string")))


def fixed2(c: str | Column) -> Column:
    """Two-decimal text of a double, rounded from its exact binary value
    (``format_number``; ``format_string('%.2f')`` would round the shortest
    decimal form half-up and differ on values such as 1.015)."""
    return F.regexp_replace(F.format_number(col(c), 2), ",", "")


def elapsed_hms(seconds: str | Column) -> Column:
    """``{h}h {m}m {s}s`` from the components of a duration: whole days are
    dropped from the hour part, as a TimeSpan's Hours component does
    (25 h 3 m 4 s -> ``1h 3m 4s``)."""
    s = F.floor(col(seconds)).cast("long")
    h = F.floor((s % 86400) / 3600).cast("long")
    m = F.floor((s % 3600) / 60).cast("long")
    sec = (s % 60).cast("long")
    return F.format_string("%dh %dm %ds", h, m, sec)
