"""Series: exponential smoothing, timers that reset, progress."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered


CHUNK = 65_536  # elements that one task smooths at once


def _smooth(weight: float, seeded: bool):
    """Kernel over (group, chunk): each element smoothed from nothing, or from the first value in a series' first chunk."""

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["i"].to_numpy(), kind="stable")
        rows = rows.take(order)
        values, out, last = rows["v"].to_pylist(), [], 0.0
        first = seeded and rows.num_rows and rows["i"][0].as_py() == 0
        for k, v in enumerate(values):
            last = v if first and k == 0 else last * weight + v * (1 - weight)
            out.append(last)
        return rows.append_column("part", pa.array(out, pa.float64()))

    return run


def _carry(weight: float):
    """Kernel over the ends of a group's chunks: what each chunk starts from."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(np.argsort(rows["chunk"].to_numpy(), kind="stable"))
        out, last = [], 0.0
        for end, n in zip(rows["end"].to_pylist(), rows["n"].to_pylist()):
            out.append(last)
            last = end + last * weight**n
        return rows.drop_columns(["end", "n"]).append_column("carry", pa.array(out, pa.float64()))

    return run


def ema(df: DataFrame, group: list[str], order: str, value: str, weight: float) -> DataFrame:
    """First-order smoothing seeded with the first value: one row per element.

    A series is cut into chunks, so that a long one is not gathered: smoothing is linear, and what a chunk starts from
    follows from the ends of the chunks before, one row each.
    """
    rows = numbered(df.select(*group, order, F.col(value).cast("double").alias("v")), [order], "i", within=group).withColumn("chunk", F.floor(F.col("i") / CHUNK).cast("long"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    parts = rows.groupBy(*group, "chunk").applyInArrow(_smooth(weight, True), kinds + ", part double")
    ends = parts.groupBy(*group, "chunk").agg(F.max_by("part", "i").alias("end"), F.count("*").alias("n"))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*group, "chunk").schema)
    carries = ends.groupBy(*group).applyInArrow(_carry(weight), keys + ", carry double")
    met = parts.join(carries, [*group, "chunk"])
    return met.select(*group, order, (F.col("part") + F.col("carry") * F.pow(F.lit(weight), F.col("i") - F.col("chunk") * CHUNK + 1)).alias("smooth"))


def timer_average(df: DataFrame, group: list[str], order: str, value: str, window: int) -> DataFrame:
    """Average since the last reset; the timer resets when its count passes ``window``."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    d = df.withColumn("segment", F.floor((n - 1) / (window + 1)).cast("long"))
    return d.withColumn("average", F.avg(value).over(Window.partitionBy(*group, "segment").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def eta(elapsed: Column, start: Column, i: Column, most: Column) -> Column:
    return elapsed / (i - start + 1) * (most - i - 1)
