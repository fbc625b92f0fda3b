"""Preference formatting, in DataFrame operations alone.

Two conversations that answer the same opening are a pair: one chosen, one rejected.  The longest common prefix
of their turns (same role and text) is rendered once as the prompt; what follows is rendered for either side, with
the character spans of the assistant's turns as loss mask (``[start, end)`` in the completion; the rest, other
roles and the turn headers, is masked out).  The two sides meet in one aggregation by pair, so the turns are shuffled once.

Defined cases: a null role is ``unknown``, a null text is empty, a null turn number comes last; repeated turns are kept, ordered by
role and text; a conversation without a partner is the chosen or the rejected side of a pair whose other side is null and whose prefix is
empty; null conversation ids form one conversation, chosen, of the null pair; texts of any length are rendered whole; an empty table gives an empty result; other
columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

LAST = (1 << 63) - 1


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit("<|end|>\n"))), "")


def _mask(turns: Column) -> Column:
    """Spans ``start-end`` of assistant texts (with their end mark) in ``render(turns)``, comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_head(t))
        end = begin + F.length(t["text"]) + 7
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))))).otherwise(acc["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, add, lambda acc: F.array_join(acc["spans"], ","))


def format_preferences(turns: DataFrame, pair: Column, chosen: Column, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per pair. ``pair`` names the pair of a turn's conversation, ``chosen`` its side."""
    turn = F.struct(
        F.coalesce(F.col(turn_col).cast("long"), F.lit(LAST)).alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    rows = turns.select(pair.alias("pair_id"), F.coalesce(chosen, F.lit(True)).alias("side"), F.col(conv_col).alias("conv"), turn.alias("t"))
    sides = rows.groupBy("pair_id").agg(
        F.min(F.when(F.col("side"), F.col("conv"))).alias("chosen_id"),
        F.min(F.when(~F.col("side"), F.col("conv"))).alias("rejected_id"),
        F.array_sort(F.collect_list(F.when(F.col("side"), F.col("t")))).alias("a"),
        F.array_sort(F.collect_list(F.when(~F.col("side"), F.col("t")))).alias("b"),
    )
    differs = F.array_position(F.zip_with("a", "b", lambda x, y: ~(x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))), True).cast("int")
    sides = sides.withColumn("n", F.when(differs == 0, F.size("a")).otherwise(differs - 1))
    rest = lambda c: F.when(F.size(c) > 0, F.slice(c, F.col("n") + 1, F.size(c) + 1))
    sides = sides.withColumn("ra", rest("a")).withColumn("rb", rest("b"))
    return sides.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n").cast("long").alias("n_prefix"), render(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        render(F.col("ra")).alias("chosen"), _mask(F.col("ra")).alias("chosen_mask"), render(F.col("rb")).alias("rejected"), _mask(F.col("rb")).alias("rejected_mask"),
    )


def opening_pairs(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pair_id, side): conversations of one opening, in the order of their ids, are taken two by two; the first of two is chosen and names the pair.

    An opening may stand in a third of all conversations, so its conversations are numbered without being gathered: they are dealt in
    ranges, numbered inside a range, and the sizes of the ranges before are added.
    """
    scratch, n = Scratch(turns.sparkSession), int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.min(F.struct(F.coalesce(F.col(turn_col).cast("long"), F.lit(LAST)), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    convs = turns.where(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).alias("conv")).agg(first.alias("f"))
    convs = convs.select("conv", F.md5(F.concat("f.role", F.lit("\x1f"), "f.text")).alias("opening"))
    # Range bounds are sampled anew in every run: they are written once.
    ranged = scratch.write(convs.repartitionByRange(n, "opening", "conv").select("conv", "opening", F.spark_partition_id().alias("part")), "chat-ranges")
    sizes = ranged.groupBy("opening", "part").agg(F.count("*").alias("size"))
    sizes = sizes.select(F.col("opening").alias("s_opening"), F.col("part").alias("s_part"), (F.sum("size").over(Window.partitionBy("opening").orderBy("part")) - F.col("size")).alias("before"))
    numbered = ranged.withColumn("nth", F.row_number().over(Window.partitionBy("part", "opening").orderBy("conv")))
    numbered = numbered.join(sizes, (F.col("opening") == F.col("s_opening")) & (F.col("part") == F.col("s_part")))
    two = numbered.groupBy("opening", F.floor((F.col("before") + F.col("nth") - 1) / 2).alias("half")).agg(F.array_sort(F.collect_list("conv")).alias("convs"))
    out = two.select(F.explode("convs").alias("conv"), F.col("convs")[0].alias("pair_id")).withColumn("side", F.col("conv") == F.col("pair_id"))
    out = scratch.write(out, "chat-pairs")
    scratch.close("chat-pairs")
    return out


def opening_preferences(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``format_preferences`` of conversations that answer the same opening, their first turn."""
    columns = {"conv_col": conv_col, "turn_col": turn_col, "role_col": role_col, "text_col": text_col}
    pairs = opening_pairs(turns, **columns).withColumnsRenamed({"conv": "p_conv", "pair_id": "p_pair", "side": "p_side"})
    met = turns.select(*columns.values()).join(pairs, F.col(conv_col) == F.col("p_conv"), "left")
    return format_preferences(met, F.col("p_pair"), F.col("p_side"), **columns)


def adjacent_pairs(conv: str = "conv_id") -> tuple[Column, Column]:
    """For tables that hold pairs side by side: conversations 2k and 2k + 1 are pair k; the even one is chosen."""
    return F.floor(F.col(conv) / 2).cast("long"), F.pmod(F.col(conv), F.lit(2)) == 0
