"""Row numbers over a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def numbered(df: DataFrame, order: list, name: str, within: list[str] | None = None) -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of ``order`` (inside each value of ``within``).

    Rows are dealt in ranges of (within, order), numbered inside a range, and the sizes of the ranges before are added: a hot
    group, or no group at all, is spread over all tasks.  Ties are broken arbitrarily but once: the ranges are written.
    """
    within = within or []
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *within, *order).withColumn("_part", F.spark_partition_id()))
    local = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy(*within, "_part").orderBy(*order)) - 1)
    sizes = ranged.groupBy(*within, "_part").agg(F.count("*").alias("_size"))
    # One row a range and group: the running sum is over as many rows as there are ranges.
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*[F.col(c) for c in within] or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(c).alias(f"_w{k}") for k, c in enumerate(within)], F.col("_part").alias("_p"), before.alias("_before"))
    on = F.col("_part") == F.col("_p")
    for k, c in enumerate(within):
        on = on & F.col(c).eqNullSafe(F.col(f"_w{k}"))
    return local.join(sizes, on).withColumn(name, (F.col("_before") + F.col("_nth")).cast("long")).drop("_part", "_nth", "_before", "_p", *[f"_w{k}" for k in range(len(within))])
