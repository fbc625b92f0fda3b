"""Signal quality and losses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def psnr(mse: Column, peak: float = 255.0) -> Column:
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(peak * peak / mse))


def psnr_batch(mse: Column) -> Column:
    return 10 * F.log10(1 / (mse + 1e-8))


def losses(df: DataFrame, by: list[str], a: Column, b: Column, weight: Column, eps: float = 1e-12) -> DataFrame:
    d = a - b
    return df.groupBy(*by).agg(
        F.avg(F.abs(d)).alias("l1"), F.avg(d * d).alias("mse"), F.avg(F.sqrt(d * d + eps)).alias("charbonnier"), (F.sum(F.abs(d) * weight) / F.sum(weight)).alias("weighted_l1")
    )


def moments(df: DataFrame, group: str, vector: str) -> DataFrame:
    e = df.select(group, F.posexplode(vector).alias("dim", "v"))
    return e.groupBy(group, "dim").agg(F.avg(F.col("v").cast("double")).alias("mu"), F.var_samp(F.col("v").cast("double")).alias("var"))


def frechet_diagonal(m: DataFrame, group: str, one, two) -> DataFrame:
    """Frechet distance of two groups under diagonal covariances."""
    side = lambda g, s: m.where(F.col(group) == g).select("dim", F.col("mu").alias(f"mu{s}"), F.col("var").alias(f"var{s}"))
    j = side(one, 1).join(side(two, 2), "dim")
    d = F.col("mu1") - F.col("mu2")
    return j.agg(F.sum(d * d + F.col("var1") + F.col("var2") - 2 * F.sqrt(F.col("var1") * F.col("var2"))).alias("distance"))


def gram_matrix(df: DataFrame, vector: str) -> DataFrame:
    """Mean products of all dimensions, summed per partition before the shuffle; a pair counts the rows that have both."""

    def add(batches):
        sums = hits = np.zeros((0, 0))
        for batch in batches:
            rows = [v for v in batch.column(0).to_pylist() if v]
            x = np.full((len(rows), max([len(sums), *map(len, rows)])), np.nan)
            for k, v in enumerate(rows):
                x[k, : len(v)] = [np.nan if e is None else e for e in v]
            known = ~np.isnan(x)
            x, known, more = np.where(known, x, 0.0), known.astype(float), x.shape[1] - len(sums)
            sums, hits = (np.pad(m, (0, more)) + y.T @ y for m, y in ((sums, x), (hits, known)))
        i, j = np.nonzero(hits)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[i, j]), pa.array(hits[i, j].astype(np.int64))], names=["i", "j", "s", "n"])

    parts = df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(add, "i int, j int, s double, n long")
    return parts.groupBy("i", "j").agg((F.sum("s") / F.sum("n")).alias("g"))


def frechet(df: DataFrame, label: str, vector: str, a, b) -> DataFrame:
    """One row: ``|mu_a - mu_b|^2 + Tr(C_a + C_b - 2 (C_a C_b)^(1/2))`` of two labels' vectors.

    Means and product sums are aggregated in the cluster; only the two matrices, whose size is the vectors' dimension, reach the driver.
    """
    stats = []
    for k in (a, b):
        some = df.where(F.col(label) == F.lit(k)).select(F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
        one = some.select(F.concat(F.array(F.lit(1.0)), "v").alias("v"))  # the products with 1 are the means
        cells = gram_matrix(one, "v").collect()
        size, n = max(r["i"] for r in cells) + 1, some.count()
        m = np.zeros((size, size))
        for r in cells:
            m[r["i"], r["j"]] = r["g"]
        mean = m[0, 1:]
        stats.append((mean, (m[1:, 1:] - np.outer(mean, mean)) * n / max(n - 1, 1)))
    (m1, c1), (m2, c2) = stats
    w, v = np.linalg.eigh(c1)
    root = (v * np.sqrt(np.maximum(w, 0))) @ v.T  # Tr (C1 C2)^(1/2) = Tr (C1^(1/2) C2 C1^(1/2))^(1/2), which is symmetric
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ c2 @ root), 0)).sum()
    value = float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * cross)
    return df.sparkSession.range(1).select(F.lit(value).alias("distance"))


def total_variation(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn("d", F.abs(F.col(value) - F.lag(value).over(w))).groupBy(*group).agg(F.sum("d").alias("tv"), F.count("d").alias("steps"))


def ssim_blocks(df: DataFrame, by: list[str], x: str, y: str, peak: float = 255.0) -> DataFrame:
    """Structural similarity of whole blocks from population moments."""
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    m = df.groupBy(*by).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"))
    s = (2 * F.col("mx") * F.col("my") + c1) * (2 * F.col("c") + c2) / ((F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + c1) * (F.col("vx") + F.col("vy") + c2))
    return m.select(*by, s.alias("ssim"))
