"""Folders, arrays, label images and text sinks, through Spark's readers and writers only."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rasters import decode_png, encode_png


def listed(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (), recursive: bool = False) -> DataFrame:
    """(path, name, size) of the files of a folder by suffix; names that begin with a dot are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select("path", name.alias("name"), F.col("length").alias("size")).where(~F.col("name").startswith("."))
    wanted = F.lit(not suffixes)
    for s in suffixes:
        wanted = wanted | F.col("name").endswith(s)
    return found.where(wanted)


def _cells(decode):
    """Kernel (path, content) -> (path, y, x, value), a file in pieces of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                grid = decode(content.as_py())
                step = max(1, (1 << 18) // max(grid.shape[1], 1))
                for top in range(0, grid.shape[0], step):
                    part = grid[top : top + step]
                    y, x = np.indices(part.shape)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * part.size, pa.string()), pa.array((y + top).ravel().astype(np.int64)), pa.array(x.ravel().astype(np.int64)), pa.array(part.ravel().astype(np.int64))], names=["path", "y", "x", "value"]
                    )

    return run


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def read_npy(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """(path, y, x, value) of two-dimensional integer arrays; pickled objects are refused."""
    return _files(spark, path, pattern).mapInArrow(_cells(lambda data: np.load(io.BytesIO(data), allow_pickle=False)), "path string, y long, x long, value long")


def labels_of(pixels: np.ndarray) -> np.ndarray:
    """Labels of a label image: red, green and blue are the digits of a number to base 256; transparent is -1."""
    wide = pixels.astype(np.int64)
    out = (wide[:, :, 0] << 16) + (wide[:, :, 1] << 8) + wide[:, :, 2]
    return out if pixels.shape[2] == 3 else np.where(pixels[:, :, 3] == 0, -1, out)


def label_image(labels: np.ndarray) -> np.ndarray:
    """The label image of labels: -1 is transparent black."""
    shown = np.maximum(labels, 0)
    return np.dstack([shown >> 16 & 255, shown >> 8 & 255, shown & 255, np.where(labels < 0, 0, 255)]).astype(np.uint8)


def read_labels(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """(path, y, x, value): the labels of label images."""
    return _files(spark, path, pattern).mapInArrow(_cells(lambda data: labels_of(decode_png(data))), "path string, y long, x long, value long")


def label_files(pixels: DataFrame, frame: str) -> DataFrame:
    """(frame, content): a label PNG of each frame's (y, x, value); a frame is one file, so its size does not grow with the data."""
    kind = pixels.schema[frame].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        grid = np.full((int(y.max()) + 1, int(x.max()) + 1), -1, np.int64)
        grid[y, x] = rows["value"].to_numpy()
        return pa.table({frame: rows[frame].slice(0, 1), "content": pa.array([encode_png(label_image(grid))], pa.binary())})

    return pixels.select(frame, "y", "x", "value").groupBy(frame).applyInArrow(run, f"{frame} {kind}, content binary")


def label_channels(label: Column) -> list[Column]:
    """r, g, b, a of a label."""
    shown = F.greatest(label, F.lit(0))
    return [F.shiftright(shown, k).bitwiseAND(255) for k in (16, 8, 0)] + [F.when(label < 0, 0).otherwise(255)]


def channels_label(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.when(a == 0, -1).otherwise(r * 65536 + g * 256 + b)


def write_text(lines: DataFrame, order: list[str], path: str) -> None:
    """Lines (column ``line``) of a report in their order, as one text file: a report has a bounded number of lines."""
    lines.orderBy(*order).coalesce(1).select("line").write.mode("overwrite").text(path)
