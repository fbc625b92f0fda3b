"""Reference planning: nearest anchors, steps toward them, lagged and positional pairs, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_anchor(df: DataFrame, group: list[str], order: str, anchor: Column) -> DataFrame:
    """Position of the nearest anchor row on either side, the earlier on ties, without a range join."""
    w = Window.partitionBy(*group).orderBy(order)
    at = F.when(anchor, F.col(order))
    out = df.withColumn("before", F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    near = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull(), F.col("before")).when(F.col(order) - F.col("before") <= F.col("after") - F.col(order), F.col("before")).otherwise(F.col("after"))
    return out.withColumn("nearest", near).drop("before", "after")


def step_toward(position: Column, nearest: Column) -> Column:
    return F.when(nearest == position, position).when(nearest < position, position - 1).otherwise(position + 1)


def depth(position: Column, nearest: Column) -> Column:
    """Place in dependency order: a row needs the row one step nearer to its anchor."""
    return F.abs(position - nearest)


def lag_pairs(df: DataFrame, group: list[str], order: str, distances: list[int]) -> DataFrame:
    later = df.select(*group, F.col(order).alias("later"), F.explode(F.array(*map(F.lit, distances))).alias("distance"))
    earlier = df.select(*group, F.col(order).alias("earlier"))
    return later.withColumn("earlier", F.col("later") - F.col("distance")).join(earlier, [*group, "earlier"]).select(*group, "later", "earlier", "distance")


def positional_zip(a: DataFrame, b: DataFrame, group: str, order_a: str, order_b: str) -> DataFrame:
    number = lambda d, o: d.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(o)))
    return number(a, order_a).join(number(b, order_b), [group, "place"])


def propagate(df: DataFrame, group: list[str], order: str, anchor: Column, value: Column) -> DataFrame:
    """Anchors' values along the chains of nearest anchors."""
    near = nearest_anchor(df, group, order, anchor)
    values = df.where(anchor).select(*group, F.col(order).alias("nearest"), value.alias("label"))
    return near.join(values, [*group, "nearest"], "left")
