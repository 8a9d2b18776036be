"""Chat formatting: snapshots of growing conversations are collapsed to the maximal
ones, which are rendered.  DataFrame operations only.

A log that stores a conversation after every turn holds all its prefixes.  Every
turn gets two 64-bit hashes of its position, role and text; the rolling hash of a
prefix is their exclusive-or up to its last turn, so it is a prefix sum and needs
no chain through one task: a window inside (conversation, bucket of turns), and
one over the bucket totals.  A conversation whose whole hash is a proper prefix of
a longer one goes by anti-join; of equal conversations the one with the smallest
conv_id stays.  What remains is rendered in parts of at most ``PART_TURNS`` turns,
so the longest conversation is no larger a row than others.

Order: by turn (null first), then by content; rows that repeat a turn are turns of
their own.  Defined results: rows without conv_id belong to no conversation and
are left out; a null role or text renders as empty, and is not equal to an empty
one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import staged

PART_TURNS = 1_000
START, END = "<|im_start|>", "<|im_end|>"


def _before(df: DataFrame, aggregates: dict, order: list) -> DataFrame:
    """Per row, each ``aggregate(column)`` over the rows of its conversation before it."""
    first = Window.unboundedPreceding
    totals = df.groupBy("conv_id", "bucket").agg(*[f(F.col(c)).alias(f"t_{c}") for c, f in aggregates.items()])
    across = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(first, -1)
    carried = staged(totals.select(F.col("conv_id").alias("b_conv"), F.col("bucket").alias("b_bucket"),
                                   *[f(F.col(f"t_{c}")).over(across).alias(f"a_{c}") for c, f in aggregates.items()]), "carried")
    inside = Window.partitionBy("conv_id", "bucket").orderBy(*order).rowsBetween(first, -1)
    local = df
    for c, f in aggregates.items():
        local = local.withColumn(f"l_{c}", f(F.col(c)).over(inside))
    return local.join(carried, (F.col("conv_id") == F.col("b_conv")) & (F.col("bucket") == F.col("b_bucket"))).drop("b_conv", "b_bucket")


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, bucket, content, role, text``: the turns with their positions from 1."""
    def marked(c: str):
        return F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("-"))

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text",
                        F.md5(F.concat(marked("role"), F.lit("\x1f"), marked("text"))).alias("content"), F.lit(1).cast("long").alias("one"))
    # turns without a number come first, in buckets of their content
    no_turn = F.conv(F.substring("content", 1, 3), 16, 10).cast("long") - F.lit(1 << 62)
    rows = rows.filter("conv_id is not null").withColumn("bucket", F.coalesce(F.floor(F.col("turn") / PART_TURNS), no_turn))
    placed = _before(rows, {"one": F.sum}, ["turn", "content"])
    pos = F.coalesce("a_one", F.lit(0)) + F.coalesce("l_one", F.lit(0)) + 1
    return placed.select("conv_id", pos.cast("long").alias("pos"), "content", "role", "text")


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` of the conversations that are no prefix of a longer one; ``turns`` is numbered."""
    marks = turns.select("conv_id", "pos", F.floor((F.col("pos") - 1) / PART_TURNS).alias("bucket"),
                         F.xxhash64(F.lit(1), "pos", "content").alias("h"), F.xxhash64(F.lit(2), "pos", "content").alias("g"))
    whole = marks.groupBy("conv_id").agg(F.max("pos").alias("n"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"))
    one = staged(whole.groupBy("n", "h", "g").agg(F.min("conv_id").alias("conv_id")), "conversations")
    # proper prefixes: up to each turn but the first, what came before it
    before = _before(marks, {"h": F.bit_xor, "g": F.bit_xor}, ["pos"]).filter("pos > 1")

    def joined(c: str):
        return F.coalesce(f"a_{c}", F.lit(0).cast("long")).bitwiseXOR(F.coalesce(f"l_{c}", F.lit(0).cast("long")))

    prefixes = staged(before.select((F.col("pos") - 1).alias("p_n"), joined("h").alias("p_h"), joined("g").alias("p_g")).distinct(), "prefixes")
    same = (F.col("n") == F.col("p_n")) & (F.col("h") == F.col("p_h")) & (F.col("g") == F.col("p_g"))
    return one.join(prefixes, same, "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per part of a maximal conversation: ``conv_id, n_turns`` (of the whole),
    ``part, part_turns, text``."""
    rows = staged(numbered(turns), "turns")
    kept = staged(maximal(rows).select(F.col("conv_id").alias("k_conv"), "n_turns"), "maximal")
    line = F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    part = F.floor((F.col("pos") - 1) / part_turns).cast("long")
    lines = rows.join(kept, F.col("conv_id") == F.col("k_conv")).select("conv_id", "n_turns", part.alias("part"), "pos", line.alias("line"))
    # at most part_turns lines each
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "")
    return (lines.groupBy("conv_id", "n_turns", "part").agg(F.count("*").alias("part_turns"), whole.alias("text")))
