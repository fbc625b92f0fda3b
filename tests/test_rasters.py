"""Round trips and hand-made bytes of the raster formats."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionframe.sources import rasters


def filtered_png(image, kinds):
    """A PNG whose line k has filter kinds[k]."""
    h, w, c = image.shape
    lines, out = image.reshape(h, -1).astype(int), b""
    for k, line in enumerate(lines):
        up = lines[k - 1] if k else np.zeros_like(line)
        left, corner = (np.concatenate([np.zeros(c, int), x[:-c]]) for x in (line, up))
        p = left + up - corner
        near = np.abs(np.stack([p - left, p - up, p - corner])).argmin(0)
        guess = [0 * line, left, up, (left + up) // 2, np.choose(near, [left, up, corner])][kinds[k]]
        out += bytes([kinds[k]]) + ((line - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    return rasters.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [3, 4])
def test_png_filters(channels):
    image = np.random.default_rng(1).integers(0, 256, (10, 7, channels), dtype=np.uint8)
    assert (rasters.decode_png(filtered_png(image, [0, 1, 2, 3, 4] * 2)) == image).all()


def test_palette_and_bits():
    chunk = lambda kind, x: struct.pack(">I", len(x)) + kind + x + b"0000"
    make = lambda depth, colour, body, more=b"": rasters.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 1, depth, colour, 0, 0, 0)) + more + chunk(b"IDAT", zlib.compress(body))
    assert rasters.decode_png(make(1, 0, b"\x00\xa0"))[0, :, 0].tolist() == [255, 0, 255]
    plte = chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6])) + chunk(b"tRNS", bytes([9]))
    assert rasters.decode_png(make(2, 3, b"\x00\x10", plte))[0].tolist() == [[1, 2, 3, 9], [4, 5, 6, 255], [1, 2, 3, 9]]


def test_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    flow = rng.standard_normal((5, 4, 2)).astype(np.float32)
    grey = rng.standard_normal((3, 6, 1)).astype(np.float32)
    deep = rng.integers(0, 65536, (300, 4, 3), dtype=np.uint16)
    files = {"a.flo": rasters.encode_flo(flow), "b.pfm": rasters.encode_pfm(grey), "c.png": rasters.encode_png(deep), "d.png": b"junk", "e.flo": b"PIEH", "f.txt": b"x"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    lines = rasters.read_rasters(spark, str(tmp_path)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    rows = lines.collect()
    assert {r.name for r in rows if r.error} == {"d.png", "e.flo"}
    for name, image in (("a.flo", flow), ("b.pfm", grey), ("c.png", deep)):
        got = sorted((r for r in rows if r.name == name), key=lambda r: r.y)
        assert (np.array([r["values"] for r in got], np.float32) == image.reshape(len(image), -1)).all()
    uv = {(r.y, r.x): (r.u, r.v) for r in rasters.cells(lines.where("name = 'a.flo'"), ["u", "v"]).collect()}
    assert len(uv) == 20 and uv[3, 2] == tuple(flow[3, 2].tolist())
    k = rasters.cells(lines.where("name = 'c.png'"), ["r", "g", "b"]).select("y", "x", *rasters.kitti_flow(F.col("r"), F.col("g"), F.col("b"))).where("y = 7 and x = 1").first()
    assert (k.u, k.v, k.valid) == ((deep[7, 1, 0] - 32768.0) / 64, (deep[7, 1, 1] - 32768.0) / 64, bool(deep[7, 1, 2] > 0))
    d = spark.range(1).select(*rasters.kitti_disparity(F.lit(512.0))).first()
    assert (d.u, d.v, d.valid) == (-2.0, 0.0, True)
    for name, kind, bits in (("a.flo", "flo", 8), ("b.pfm", "pfm", 8), ("c.png", "png", 16)):
        assert bytes(rasters.encoded(lines.where(F.col("name") == name), kind, bits).first().content) == files[name]
    assert rasters.scan_lines(spark.createDataFrame([], "path string, content binary")).count() == 0
