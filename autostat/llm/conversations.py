"""Chat formatting: collapse logged snapshots of one conversation, then render what is left.

Every turn of a conversation gets the rolling hash of all turns up to it: the exclusive or of 64-bit hashes of
(position, role, text), twice with different salts, so 128 bits. A conversation of n turns whose last rolling hash
is the n-th rolling hash of a longer conversation is a snapshot of it and is removed by an anti-join; of equal
conversations the smallest id stays. Both sides of the anti-join have one row per (length, hash), however many
conversations start alike.

Positions and rolling hashes are taken in chunks of `CHUNK` turn numbers, whose counts and hashes are then summed up
per conversation, so a conversation with a third of all turns is spread over many tasks. Rendering is by turn.

Defined results: turns are ordered by turn, role and text, nulls first; a turn logged twice (all of the four equal)
counts once; a null role or text differs from an empty one when comparing and renders as empty; a null conversation
id is a conversation of its own; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def positioned(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text") -> DataFrame:
    """Distinct turns with position (from 1), n_turns, and the rolling hashes h1 and h2."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    ).distinct()
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(2**62))))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    rows = rows.withColumn("at", F.row_number().over(inside).cast("long"))
    counts = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv_id", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"),
                           F.sum("n").over(Window.partitionBy("conv_id")).alias("n_turns"))
    rows = by_chunk(rows, starts).withColumn("position", F.col("start") + F.col("at"))
    missing = F.concat(F.col("role").isNull().cast("string"), F.col("text").isNull().cast("string"))
    hashed = [F.xxhash64(F.lit(salt), "position", missing, "role", "text").alias(f"t{salt}") for salt in (1, 2)]
    rows = rows.select("conv_id", "chunk", "position", "n_turns", "role", "text", *hashed)
    chunks = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("t1").alias("c1"), F.bit_xor("t2").alias("c2"))
    before = chunks.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(f"c{s}").over(earlier), F.lit(0)).alias(f"b{s}")
                                                 for s in (1, 2)])
    running = Window.partitionBy("conv_id", "chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rolled = by_chunk(rows, before)
    return rolled.select("conv_id", "position", "n_turns", "role", "text",
                         *[F.col(f"b{s}").bitwiseXOR(F.bit_xor(f"t{s}").over(running)).alias(f"h{s}") for s in (1, 2)])


def by_chunk(rows: DataFrame, of_chunk: DataFrame) -> DataFrame:
    """`rows` with the columns of their chunk."""
    named = of_chunk.withColumnsRenamed({"conv_id": "_conv", "chunk": "_chunk"})
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk"))
    return rows.join(named, same).drop("_conv", "_chunk")


def maximal(placed: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that neither start a longer one nor repeat one with a smaller id."""
    last = F.col("position") == F.col("n_turns")
    ends = placed.where(last).groupBy("n_turns", "h1", "h2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal")
    )
    starts = placed.where(~last).select(F.col("position").alias("n_turns"), "h1", "h2").distinct()
    return ends.join(starts, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_equal")


def segment(role: Column, text: Column) -> Column:
    """A turn as training text."""
    head = F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"))
    return F.concat(head, F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def rendered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """One row per turn of every maximal conversation: conv_id, n_turns, position, role, segment. The conversation
    is the concatenation of its segments by position."""
    placed = positioned(turns, conv_id, turn, role, text)
    kept = maximal(placed).select(F.col("conv_id").alias("_kept"))
    chosen = placed.join(kept, F.col("conv_id").eqNullSafe(F.col("_kept")), "left_semi")
    return chosen.select("conv_id", "n_turns", "position", "role", segment(F.col("role"), F.col("text")).alias("segment"))
