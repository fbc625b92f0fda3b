"""Region-level evaluation and its roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def region_metrics(regions: DataFrame, by: list[str], hit: Column, gt_bg: Column, pred_bg: Column, npix: str, threshold: int, line_pixels: Column | None = None) -> DataFrame:
    """acc, acc_thres, pix_acc, pix_acc_wobg, bmiou, pix_bmiou of each group, in one aggregation.

    acc_thres divides by the regions above the threshold, plus the line label if ``line_pixels`` passes it, less one; without
    ``line_pixels`` by the regions above the threshold. pix_acc_wobg is null if all is background; no background at all gives bmiou 1.
    """
    one = lambda c: F.sum(F.when(c, 1e0).otherwise(0e0))
    px = lambda c: F.sum(F.when(c, F.col(npix).cast("double")).otherwise(0e0))
    large = F.col(npix) > threshold
    extra = F.lit(0) if line_pixels is None else F.max(F.when(line_pixels > threshold, 0e0).otherwise(-1e0))
    zero_safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0e0)), F.lit(1e0))
    return regions.groupBy(*by).agg(
        (one(hit) / F.count("*")).alias("acc"),
        (one(hit & large) / F.nullif(one(large) + extra, F.lit(0e0))).alias("acc_thres"),
        (px(hit) / F.nullif(F.sum(F.col(npix).cast("double")), F.lit(0e0))).alias("pix_acc"),
        (px(hit & ~gt_bg) / F.nullif(px(~gt_bg), F.lit(0e0))).alias("pix_acc_wobg"),
        zero_safe(one(gt_bg & pred_bg), one(gt_bg | pred_bg)).alias("bmiou"),
        zero_safe(px(gt_bg & pred_bg), px(gt_bg | pred_bg)).alias("pix_bmiou"),
    )


def rollup_mean(df: DataFrame, levels: list[str], value: Column) -> DataFrame:
    return df.rollup(*levels).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def skip_first_means(df: DataFrame, folder: str, index: str, value: Column) -> DataFrame:
    """Mean of each folder without its first element."""
    return df.where(F.col(index) > 0).groupBy(folder).agg(F.avg(value).alias("mean"))


def split_means(df: DataFrame, group: list[str], index: str, value: str, size: int = 20) -> DataFrame:
    """Mean over a group's sequences of ``size``: each without its first element, divided by ``size`` - 1; null for a group without a whole sequence."""
    rest = F.sum(F.when(F.col(index) % size > 0, F.col(value)))
    return df.groupBy(*group).agg((rest / (size - 1) / F.nullif(F.floor(F.count("*") / size), F.lit(0))).alias("mean"))


def camera_means(df: DataFrame, group: list[str], index: Column, value: str, cameras: list[tuple[str, int]], size: int = 20) -> DataFrame:
    """(group, camera, mean, overall): ``cameras`` (name, frames) follow each other in a group; sequences are counted inside a camera, ``overall`` is the mean of the cameras."""
    name, inside, start = F.lit(None).cast("string"), F.lit(None).cast("long"), 0
    for label, frames in cameras:
        here = (index >= start) & (index < start + frames)
        name, inside, start = F.when(here, label).otherwise(name), F.when(here, index - start).otherwise(inside), start + frames
    placed = df.withColumns({"camera": name, "inside": inside}).where("camera is not null")
    means = split_means(placed, [*group, "camera"], "inside", value, size)
    return means.withColumn("overall", F.avg("mean").over(Window.partitionBy(*group)))


def best_so_far(df: DataFrame, group: list[str], order: str, value: str, higher: bool = True) -> DataFrame:
    """Running best value and the latest row that reached it."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    pick = F.max(F.struct(F.col(value).alias("v"), F.col(order).alias("i"))) if higher else F.max(F.struct((-F.col(value)).alias("v"), F.col(order).alias("i")))
    best = df.withColumn("b", pick.over(w))
    return best.withColumn("best", F.col("b.v") if higher else -F.col("b.v")).withColumn("best_at", F.col("b.i")).drop("b")


def report(sections: list[tuple[int, DataFrame]]) -> DataFrame:
    """Sections under each other, with an order column, for a CSV sink."""
    out = None
    for k, d in sections:
        part = d.withColumn("section", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out
