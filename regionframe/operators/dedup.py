"""Exact and near duplicates: keyed first occurrence, banded Hamming pairs, greedy keys, expansion."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .ordering import numbered


def exact_keys(df: DataFrame, digest: Column, order: str) -> DataFrame:
    """Each row with the first row of its content: ``key``."""
    return df.withColumn("digest", digest).withColumn("key", F.min(order).over(Window.partitionBy("digest")))


def first_of_content(df: DataFrame, digest: Column, order: str) -> DataFrame:
    """One row per content, its least ``order``; aggregated before the shuffle."""
    return df.groupBy(digest.alias("digest")).agg(F.min(order).alias(order), F.count("*").alias("copies"))


def hamming_pairs(df: DataFrame, id_col: str, hash_col: str, bits: int, limit: int) -> DataFrame:
    """Pairs (a < b) whose hashes differ in fewer than ``limit`` bits.

    Distinct hashes are compared, and rows are joined to the pairs of hashes in the end. ``limit`` bands: fewer than ``limit`` differing bits leave
    one band equal, so an equi-join on (band, value) loses no pair.
    """
    rows = df.select(F.col(id_col).alias("i"), F.col(hash_col).alias("h"))
    width = -(-bits // limit)
    bands = [F.struct(F.lit(k).alias("band"), F.shiftright(F.col("h"), k * width).bitwiseAND((1 << min(width, bits - k * width)) - 1).alias("value")) for k in range(limit)]
    each = rows.select("h").distinct().select("h", F.explode(F.array(*bands)).alias("x")).select("h", "x.band", "x.value")
    left, right = each.withColumnRenamed("h", "ha"), each.withColumnRenamed("h", "hb")
    distance = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))).cast("int")
    alike = left.join(right, ["band", "value"]).where(distance < limit).select("ha", "hb", distance.alias("distance")).distinct()
    met = alike.join(rows.select(F.col("i").alias("a"), F.col("h").alias("ha")), "ha").join(rows.select(F.col("i").alias("b"), F.col("h").alias("hb")), "hb")
    return met.where("a < b").select("a", "b", "distance")


def greedy_keys(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, key): in id order a node joins the first earlier key that it pairs with, else is a key itself.

    A round settles the nodes that no open earlier node pairs with as keys, and at once all that they pair with as joined: the first open node
    at least, so the rounds end.  What a node joins is its least key and is looked up in the end.
    """
    pairs = cut(pairs.select("a", "b"))
    left, joined = pairs, None
    while not left.isEmpty():
        keys = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        now = cut(left.join(keys, "a", "left_semi").select("b").distinct())
        joined = now if joined is None else cut(joined.unionByName(now))
        left = cut(left.join(now, "b", "left_anti").join(now.withColumnRenamed("b", "a"), "a", "left_anti"))
    if joined is not None:
        pairs = pairs.join(joined.withColumnRenamed("b", "a"), "a", "left_anti")
    first = pairs.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("first"))
    return nodes.join(first, "id", "left").select("id", F.coalesce("first", "id").alias("key"))


#: Hashes of so many bits have at most 65 536 values, however many rows there are: one task scans them.
NARROW = 16


def _scan(bits: int, limit: int):
    """Key of each hash, by a scan in the order of the hashes' first ids."""
    near = [sum(1 << k for k in flipped) for n in range(limit) for flipped in combinations(range(bits), n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        rows.sort(key=lambda row: (row[1] is None, row[1]))
        key: dict[int, int | None] = {}
        for h, i in rows:
            if h not in key:
                for x in near:
                    key.setdefault(h ^ x, i)
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.int64()), pa.array([key[h] for h, _ in rows], pa.int64())], names=["h", "key"])

    return run


def greedy_hash_keys(df: DataFrame, id_col: str, hash_col: str, bits: int, limit: int) -> DataFrame:
    """(id, key) of every row: ``greedy_keys`` where hashes of ``bits`` bits pair that differ in fewer than ``limit``.

    No later key comes before the one that the first row of a hash has joined or become, so all rows of a hash have its key: hashes are resolved
    by their first ids, and copies are never paired.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(hash_col).cast("long").alias("h"))
    first = rows.groupBy("h").agg(F.min("id").alias("i"))
    if bits <= NARROW:
        keys = F.broadcast(first.repartition(1).mapInArrow(_scan(bits, limit), "h long, key long"))
    else:
        first = cut(first)
        found = greedy_keys(first.select(F.col("i").alias("id")), hamming_pairs(first, "i", "h", bits, limit))
        keys = first.join(found.withColumnRenamed("id", "i"), "i").select("h", "key")
    return rows.join(keys, "h").select("id", "key")


def expand(keys: DataFrame, order: str, count: str) -> DataFrame:
    """``count`` copies of each row, with their place in the sequence."""
    each = keys.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(count) - 1)))
    return numbered(each, [order, "copy"], "place").withColumn("place", F.col("place") + 1)


def expand_by_key(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Every row with what was computed for its key."""
    return rows.join(keys, key)
