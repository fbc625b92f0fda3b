"""Raster and flow files as scan lines: PNG, ``.flo`` and ``.pfm``, read with ``binaryFile`` and decoded in Arrow batches.

One row per scan line (path, width, height, channels, y, values) keeps records small whatever the image; ``cells`` makes one
row per pixel of them.  A file that cannot be decoded is one row with its ``error`` and no values; Spark lists no files of zero bytes.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
FLO_MAGIC = b"PIEH"
KITTI_ZERO, KITTI_FLOW, KITTI_DISPARITY = 32768.0, 64.0, 256.0

SCHEMA = "path string, width int, height int, channels int, y int, values array<float>, error string"


def _unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """Undo the filter of each scan line; ``step`` is the number of bytes of a pixel."""
    kinds, lines = raw[:, 0], raw[:, 1:].copy()
    above = np.zeros(lines.shape[1], np.uint8)
    for kind, line in zip(kinds.tolist(), lines):
        if kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            was, up = line.tolist(), above.tolist()
            for i, v in enumerate(was):
                left, corner = (was[i - step], up[i - step]) if i >= step else (0, 0)
                if kind == 3:
                    guess = (left + up[i]) // 2
                else:
                    guess = min(((abs(up[i] - corner), 0, left), (abs(left - corner), 1, up[i]), (abs(left + up[i] - 2 * corner), 2, corner)))[2]
                was[i] = (v + guess) & 255
            line[:] = was
        elif kind:
            raise ValueError(f"PNG filter {kind}")
        above = line
    return lines


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) of a PNG without interlacing; palettes are looked up."""
    if not data.startswith(PNG_SIGNATURE):
        raise ValueError("not a PNG")
    at, body, palette, alpha, head = len(PNG_SIGNATURE), [], None, None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(chunk, np.uint8)
        elif kind == b"IDAT":
            body.append(chunk)
    if head is None or head[6]:
        raise ValueError("PNG without header, or interlaced")
    width, height, depth, colour = head[:4]
    channels = PNG_CHANNELS[colour]
    per_line = (width * channels * depth + 7) // 8
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)[: height * (per_line + 1)].reshape(height, per_line + 1)
    lines = _unfilter(raw, max(1, channels * depth // 8))
    if depth == 16:
        lines = np.ascontiguousarray(lines).view(">u2")
    elif depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth)
        lines = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)[:, : width * channels]
        if colour == 0:
            lines = lines * np.uint8(255 // ((1 << depth) - 1))
    pixels = lines.reshape(height, width, channels)
    if colour == 3:
        full = palette if alpha is None else np.column_stack([palette, np.concatenate([alpha, np.full(len(palette) - len(alpha), 255, np.uint8)])])
        pixels = full[pixels[:, :, 0]]
    return pixels


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of 8 or 16 bits a channel, by the dtype of ``pixels``."""
    height, width, channels = pixels.shape
    depth = 16 if pixels.dtype.itemsize == 2 else 8
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    lines = np.ascontiguousarray(pixels.astype(">u2" if depth == 16 else np.uint8)).reshape(height, -1).view(np.uint8)
    raw = np.column_stack([np.zeros(height, np.uint8), lines]).tobytes()
    chunk = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    return PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_flo(data: bytes) -> np.ndarray:
    if data[:4] != FLO_MAGIC:
        raise ValueError("not a .flo file")
    width, height = struct.unpack_from("<ii", data, 4)
    return np.frombuffer(data, "<f4", 2 * width * height, 12).reshape(height, width, 2)


def encode_flo(flow: np.ndarray) -> bytes:
    height, width, _ = flow.shape
    return FLO_MAGIC + struct.pack("<ii", width, height) + flow.astype("<f4").tobytes()


def decode_pfm(data: bytes) -> np.ndarray:
    """Lines are stored from the bottom; the sign of the scale tells the byte order."""
    head = re.match(rb"P([Ff])\s+(\d+)\s+(\d+)\s+(-?[\d.eE+-]+)\r?\n", data)
    if not head:
        raise ValueError("not a .pfm file")
    channels, width, height = 3 if head[1] == b"F" else 1, int(head[2]), int(head[3])
    values = np.frombuffer(data, "<f4" if float(head[4]) < 0 else ">f4", width * height * channels, head.end())
    return values.reshape(height, width, channels)[::-1]


def encode_pfm(pixels: np.ndarray) -> bytes:
    height, width, channels = pixels.shape
    return b"P%s\n%d %d\n-1.0\n" % (b"F" if channels == 3 else b"f", width, height) + pixels[::-1].astype("<f4").tobytes()


DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {"png": decode_png, "flo": decode_flo, "pfm": decode_pfm}
ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {"png": encode_png, "flo": encode_flo, "pfm": encode_pfm}


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "width", "height", "channels", "y", "values", "error"]
    kinds = [pa.string(), *[pa.int32()] * 4, pa.list_(pa.float32()), pa.string()]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            try:
                image = DECODERS[path.rsplit(".", 1)[-1].lower()](content.as_py())
            except (KeyError, TypeError, ValueError, struct.error, zlib.error) as e:
                cols = [[path], *[[None]] * 5, [f"{type(e).__name__}: {e}"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
                continue
            height, width, channels = image.shape
            for lo in range(0, height, 256):
                part = np.ascontiguousarray(image[lo : lo + 256], np.float32)
                n = len(part)
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (width * channels)), pa.array(part.ravel()))
                cols = [pa.array(x, k) for x, k in zip(([path] * n, [width] * n, [height] * n, [channels] * n, range(lo, lo + n)), kinds)]
                yield pa.RecordBatch.from_arrays([*cols, values, pa.array([None] * n, pa.string())], names=names)


def scan_lines(files: DataFrame) -> DataFrame:
    """Scan lines of (path, content) rows; the extension settles the format."""
    return files.select("path", "content").mapInArrow(_lines, SCHEMA)


def read_rasters(spark: SparkSession, path: str, pattern: str = "*.{png,flo,pfm}") -> DataFrame:
    return scan_lines(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def cells(lines: DataFrame, names: list[str]) -> DataFrame:
    """One row per pixel: path, y, x and the first channels under ``names`` (null where an image has fewer)."""
    pixel = lambda x: F.struct(x.cast("int").alias("x"), *[F.when(F.col("channels") > k, F.get("values", x * F.col("channels") + k)).alias(n) for k, n in enumerate(names)])
    every = F.transform(F.sequence(F.lit(0), F.col("width") - 1), pixel)
    return lines.where(F.col("error").isNull() & (F.col("width") > 0)).select("path", "y", F.explode(every).alias("p")).select("path", "y", "p.*")


def kitti_flow(u: Column, v: Column, valid: Column) -> list[Column]:
    """u, v, valid of the 16-bit channels of a KITTI flow image."""
    return [((u - KITTI_ZERO) / KITTI_FLOW).alias("u"), ((v - KITTI_ZERO) / KITTI_FLOW).alias("v"), (valid > 0).alias("valid")]


def kitti_disparity(d: Column) -> list[Column]:
    """A 16-bit disparity image as flow to the left."""
    return [(-d / KITTI_DISPARITY).alias("u"), F.lit(0.0).alias("v"), (d > 0).alias("valid")]


def encoded(lines: DataFrame, kind: str, bits: int = 8) -> DataFrame:
    """(path, content): files of ``kind`` from scan lines, one image a group."""

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table["y"].to_numpy())
        height, channels = len(order), table["channels"][0].as_py()
        image = np.stack([np.asarray(table["values"][int(k)].values) for k in order]).reshape(height, -1, channels)
        if kind == "png":
            most = 255 if bits == 8 else 65535
            image = np.clip(np.rint(image), 0, most).astype(np.uint8 if bits == 8 else np.uint16)
        return pa.table({"path": [table["path"][0].as_py()], "content": pa.array([ENCODERS[kind](image)], pa.binary())})

    return lines.where(F.col("error").isNull()).select("path", "channels", "y", "values").groupBy("path").applyInArrow(pack, "path string, content binary")
