"""Text logs and key-value metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_log(lines: DataFrame, step: str, number: str) -> DataFrame:
    """(..., step, number) of lines whose ``value`` matches ``step``."""
    out = lines.withColumn("step", F.regexp_extract("value", step, 1).try_cast("long")).withColumn("number", F.regexp_extract("value", number, 1).try_cast("double"))
    return out.where(F.col("step").isNotNull())


def read_log(spark: SparkSession, path: str, step: str, number: str) -> DataFrame:
    return parse_log(spark.read.text(path), step, number)


def kv_meta(lines: DataFrame) -> DataFrame:
    """``name.png (h,w,c) level`` -> key, h, w, c, level."""
    p = r"^(.*)\.\w+ \((\d+),(\d+),(\d+)\) (\d+)$"
    return lines.where(F.col("value").rlike(p)).select(F.regexp_extract("value", p, 1).alias("key"), *[F.regexp_extract("value", p, k + 2).cast("int").alias(n) for k, n in enumerate(("h", "w", "c", "level"))])


def frames(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """Files of a folder with their natural order: (name, path, ord, content)."""
    from ..functions.scalars import natural_key
    from ..operators.ordering import numbered

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    placed = numbered(files.select(name.alias("name"), "path", natural_key(name).alias("key")), ["key", "path"], "ord")
    return placed.select("name", "path", "ord").join(files.select("path", "content"), "path").select("name", "path", "ord", "content")
