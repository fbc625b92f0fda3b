"""Voting, pooling, matching and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def weighted_vote(scores: DataFrame, by: list[str], value: str, weight: str, digits: int = 9) -> DataFrame:
    """The value with the largest summed weight; ties (to ``digits``) go to the smallest value."""
    sums = scores.groupBy(*by, value).agg(F.round(F.sum(weight), digits).alias("total"))
    best = sums.groupBy(*by).agg(F.min(F.struct((-F.col("total")).alias("t"), value)).alias("x"))
    return best.select(*by, F.col(f"x.{value}").alias(value), (-F.col("x.t")).alias("total"))


def lookup_color(segments: DataFrame, colors: DataFrame, key: list[str], channels: list[str]) -> DataFrame:
    """Colours of segments; a missing one is transparent black."""
    return segments.join(colors, key, "left").fillna(0, subset=channels)


def dustbin_softmax(scores: DataFrame, row: list[str], col: str, score: str, dustbin: float) -> DataFrame:
    """Best column of each row under a softmax with one more column; -1 if that one wins."""
    top = scores.groupBy(*row).agg(F.max(score).alias("top"), F.min(F.struct((-F.col(score)).alias("s"), col))[col].alias("best"), F.collect_list(score).alias("all"))
    peak = F.greatest("top", F.lit(dustbin))
    total = F.aggregate(F.array_sort("all"), F.lit(0.0), lambda s, x: s + F.exp(x - peak)) + F.exp(F.lit(dustbin) - peak)
    return top.select(*row, F.when(F.col("top") >= dustbin, F.col("best")).otherwise(F.lit("-1").cast(scores.schema[col].dataType)).alias("match"), (F.exp(peak - peak) / total).alias("probability"))


def mean_pool(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, dim, mean): mean of the vectors of each label."""
    return df.select(label, F.posexplode(vector).alias("dim", "v")).groupBy(label, "dim").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.count("*").alias("n"))


CENTERS = 10_000  # sent to all tasks at once


def nearest_center(points: DataFrame, centers: DataFrame, vector: str, center: str, name: str) -> DataFrame:
    """Each point with the nearest of a palette of centres, first on ties. A palette of more than CENTERS goes in blocks."""
    blocks = max(-(-centers.count() // CENTERS), 1)
    out, best = points, F.lit(None)
    for k in range(blocks):
        some = centers.where(F.pmod(F.xxhash64(name, center), F.lit(blocks)) == k)
        out = out.join(F.broadcast(some.agg(F.array_sort(F.collect_list(F.struct(name, center))).alias("centers"))))
        near = F.array_min(F.transform("centers", lambda c: F.struct(F.round(l2(F.col(vector), c[center]), 9).alias("distance"), c[name].alias(name))))
        best = near if k == 0 else F.array_min(F.array("near", near))
        out = out.withColumn("near", best).drop("centers")
    return out


def match_accuracy(matches: DataFrame, by: list[str], predicted: str, truth: str, area: str) -> DataFrame:
    hit = (F.col(predicted) == F.col(truth)).cast("double")
    return matches.groupBy(*by).agg(
        F.avg(hit).alias("acc"), (F.sum(hit * F.col(area)) / F.sum(area)).alias("area_acc"), F.avg(F.when(F.col(truth) >= 0, hit)).alias("valid_acc"), F.count("*").alias("n")
    )
