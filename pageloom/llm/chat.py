"""Chat formatting: logged snapshots of one conversation collapse to the longest before they are rendered.

A log that is written after every turn holds each conversation many times, as prefixes of its last state. Each turn gets
a hash of all turns up to it: two 64-bit sums (by exclusive or) of the hashes of (place, role, text), so it rolls on as a
window over the conversation. A conversation whose last hash is the hash of an earlier turn of another is a prefix of it and
goes, by an anti-join; of equal ones the smallest id stays. Both sides of that join are reduced to distinct hashes first
(map-side), so a first turn or a whole conversation that is very common gives one row, not many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` of the conversations that are not a prefix of a longer one nor a copy of one with a smaller id.

    Turns are in order of ``turn`` (null first); repeated rows count once, and rows that share a turn are in order of role
    and text. Null roles and texts differ from empty ones. Rows without ``conv_id`` belong to no conversation and go.
    """
    rows = turns.select("conv_id", "turn", "role", "text").filter("conv_id is not null").distinct()
    order = Window.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "text")))
    placed = rows.select("conv_id", F.row_number().over(order).alias("place"), "role", "text")
    own = [F.xxhash64(F.lit(s), "place", F.coalesce("role", F.lit("\0")), "role", F.coalesce("text", F.lit("\0")), "text") for s in (1, 2)]
    so_far = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.select(
        "conv_id", "place", *(F.bit_xor(h).over(so_far).alias(n) for n, h in zip(("a", "b"), own, strict=True)),
        F.lead("place").over(Window.partitionBy("conv_id").orderBy("place")).isNull().alias("last"),
    )
    ends = rolled.filter("last").groupBy("place", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    inner = rolled.filter("not last").select("place", "a", "b").distinct()
    return ends.join(inner, ["place", "a", "b"], "left_anti").select("conv_id")


def render(turns: DataFrame) -> DataFrame:
    """One row for each conversation: ``conv_id``, ``n_turns`` and ``text`` in chat markup; nulls are written as nothing.

    A conversation is one training text, so it meets in one row; its turns are gathered in order.
    """
    each = F.concat(F.lit(BEGIN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    gathered = (
        turns.select("conv_id", "turn", "role", "text").filter("conv_id is not null").distinct()
        .groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
            F.col("turn").isNotNull().alias("p"), "turn", F.col("role").isNotNull().alias("q"), "role",
            F.col("text").isNotNull().alias("r"), "text", each.alias("shown")))).alias("all"))
    )
    return gathered.select("conv_id", F.size("all").cast("long").alias("n_turns"), F.array_join("all.shown", "").alias("text"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Render the maximal conversations."""
    kept = maximal_conversations(turns)
    return render(turns.join(kept, "conv_id", "left_semi"))
