"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACE_CLASS = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session (tests) may leave it unset and gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table, whatever the file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Intermediate tables of one run in the shared folder: the lineage ends there and a lost executor costs nothing.

    A table written under a name replaces the earlier one of that name; ``close`` deletes all but those named.  What
    is deleted must not be read again: close only after the last table that depends on the others is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                remove(self.spark, self.paths.pop(name))

    def close(self, *keep: str) -> None:
        self.drop(*[name for name in self.paths if name not in keep])


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, for a table that the result needs to the end."""
    return Scratch(df.sparkSession).write(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the fast built-in; others keep their non-ASCII capitals."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and tab..carriage return; null has none."""
    runs = F.regexp_replace(text, f"[{SPACE_CLASS}]*[^{SPACE_CLASS}]+[{SPACE_CLASS}]*", "x")
    return F.when(F.coalesce(text.rlike(f"[^{SPACE_CLASS}]"), F.lit(False)), F.length(runs)).otherwise(0).cast("long")


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows, read no further than that."""
    return df.limit(rows + 1).count() <= rows
