"""Structured Streaming forms of keyed dedup and windowed totals over an event folder (extensions)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.lineage import cut, shared_dir


def _events(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path)
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name[:-1]}?" if "://" not in path else path)
    return events.withColumn("at", F.col("ts").cast("timestamp"))


def _drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run over all that is there and return the sink's rows as a table, with the number of the ``batch`` that wrote them."""
    spark = stream.sparkSession
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out: list[DataFrame] = []

    def keep(batch: DataFrame, number: int) -> None:
        out.append(cut(batch.withColumn("batch", F.lit(number))))

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def distinct_events(spark: SparkSession, path: str) -> DataFrame:
    """First event of each (user, type, minute), with state bounded by the watermark."""
    e = _events(spark, path).withColumn("minute", F.date_trunc("minute", "at")).withWatermark("at", "1 day")
    out = _drain(e.dropDuplicatesWithinWatermark(["user_id", "event_type", "minute"]).select("user_id", "event_type", "minute"), "append")
    return out.select("user_id", "event_type", F.col("minute").cast("timestamp_ntz").alias("minute"))


def hourly_totals(spark: SparkSession, path: str) -> DataFrame:
    """Totals an hour. In update mode windows behind the watermark leave the state; the last batch that wrote a window counts."""
    e = _events(spark, path).withWatermark("at", "1 day").groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = _drain(e, "update").groupBy("window", "event_type").agg(F.max(F.struct("batch", "n", "total")).alias("last"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", F.col("last.n").alias("n"), F.round("last.total", 4).alias("total"))


def session_totals(spark: SparkSession, path: str, gap: str = "6 hours") -> DataFrame:
    """Sessions of a user: number of events and total, closed once the watermark has passed them."""
    e = _events(spark, path).withWatermark("at", "1 day").groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return _drain(e, "append").select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


def _rising(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of a batch above all that came before; the state is the best value so far."""
    rows = pd.concat(list(parts)).dropna(subset=["value"]).sort_values(["at", "event_id"])
    before = rows["value"].cummax().shift()
    if state.exists:
        before = before.fillna(state.get[0]).clip(lower=state.get[0])
    if len(rows):
        top = float(rows["value"].max())
        state.update((max(top, state.get[0]) if state.exists else top,))
    out = rows[before.isna() | (rows["value"] > before)]
    yield pd.DataFrame({"user_id": [key[0]] * len(out), "event_id": out["event_id"].to_numpy(), "best": out["value"].to_numpy()})


def rising_bests(spark: SparkSession, path: str) -> DataFrame:
    """Events that beat all earlier values of their user, in order of arrival (inside a batch by time, then id). The state is one number a user."""
    e = _events(spark, path).select("user_id", "event_id", "at", "value").groupBy("user_id")
    best = e.applyInPandasWithState(_rising, "user_id long, event_id long, best double", "best double", "append", GroupStateTimeout.NoTimeout)
    return _drain(best, "append").select("user_id", "event_id", "best")
