"""Operators on pixel tables: one row a pixel with ``y``, ``x`` and channels, frames in grouping columns.

Everything is column arithmetic, equi-joins on coordinates or aggregations with map-side combine; no frame is gathered in one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# BT.601 coefficients from YCbCr (studio range, 0..255) to RGB, and the offsets added.
FROM_YCBCR = {"r": (0.00456621, 0.0, 0.00625893, -222.921), "g": (0.00456621, -0.00153632, -0.00318811, 135.576), "b": (0.00456621, 0.00791071, 0.0, -276.836)}

# Steps of the flow colour wheel between red, yellow, green, cyan, blue, magenta and red.
WHEEL = (("RY", 15), ("YG", 6), ("GC", 4), ("CB", 11), ("BM", 13), ("MR", 6))

# The JPEG luminance quantisation table (ITU-T T.81, Annex K), row by row.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)

# Where a colour book's screenshot holds its swatches.
GRID = {"h": 62, "delta_h": 24, "w": 30, "delta_w": 44, "rows": 16, "slots": 4}


def binarise(gray: Column, threshold: int = 220) -> Column:
    return F.when(gray > threshold, 255).otherwise(0)


def gray(r: Column, g: Column, b: Column) -> Column:
    """Weighted luminance of 8-bit channels."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def fillable(alpha: Column) -> Column:
    return alpha < 127


def is_black(r: Column, g: Column, b: Column, a: Column) -> Column:
    return (r == 0) & (g == 0) & (b == 0) & (a == 255)


def black_line(r: Column, g: Column, b: Column, a: Column, threshold: int = 100) -> list[Column]:
    """Everything brighter than the threshold becomes transparent white."""
    bright = F.greatest(r, g, b) > threshold
    return [F.when(bright, 255).otherwise(c) for c in (r, g, b)] + [F.when(bright, 0).otherwise(a)]


def background_alpha(r: Column, g: Column, b: Column) -> Column:
    return F.when(F.least(r, g, b) == 255, 0).otherwise(255)


def scored_regions(regions: DataFrame, group: list[str], label: str) -> DataFrame:
    """Regions that are scored: not the line (label 0), more than one pixel."""
    return regions.where(F.col(label) != 0).groupBy(*group, label).agg(F.count("*").alias("npix")).where("npix > 1")


def is_color_line(name: Column) -> Column:
    return F.coalesce(F.get(F.split(name, "_"), F.lit(1)).isin("red", "green", "blue"), F.lit(False))


def crop_to_square(pixels: DataFrame, frame: list[str], content: Column, height: int, width: int, border: int = 16) -> DataFrame:
    """Pixels of each frame's content box, widened by ``border``, moved so that the shorter side is centred in a square of ``side``."""
    box = pixels.where(content).groupBy(*frame).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    box = box.select(
        *frame, F.greatest(F.col("y0") - border, F.lit(0)).alias("y0"), F.least(F.col("y1") + border, F.lit(height - 1)).alias("y1"),
        F.greatest(F.col("x0") - border, F.lit(0)).alias("x0"), F.least(F.col("x1") + border, F.lit(width - 1)).alias("x1"),
    )
    nh, nw = F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1
    pad = F.floor(F.abs(nh - nw) / 2).cast("long")
    inside = F.col("y").between(F.col("y0"), F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1"))
    cut = pixels.join(box, frame).where(inside)
    y = F.col("y") - F.col("y0") + F.when(nh > nw, 0).otherwise(pad)
    x = F.col("x") - F.col("x0") + F.when(nh > nw, pad).otherwise(0)
    return cut.withColumns({"side": F.greatest(nh, nw), "y": y, "x": x}).drop("y0", "y1", "x0", "x1")


def crop_border(pixels: DataFrame, width: int, height: int, border: int) -> DataFrame:
    return pixels.where(F.col("y").between(border, height - 1 - border) & F.col("x").between(border, width - 1 - border))


def flow_valid(u: Column, v: Column, most: float = 1000) -> Column:
    return (F.abs(u) < most) & (F.abs(v) < most)


def wheel() -> list[tuple[int, int, int]]:
    """The colours of the flow wheel: one channel rises, then another falls, in the steps of WHEEL."""
    out = []
    for name, n in WHEEL:
        for k in range(n):
            up, down = math.floor(255 * k / n), 255 - math.floor(255 * k / n)
            out.append({"RY": (255, up, 0), "YG": (down, 255, 0), "GC": (0, 255, up), "CB": (0, down, 255), "BM": (up, 0, 255), "MR": (255, 0, down)}[name])
    return out


def flow_color(u: Column, v: Column) -> list[Column]:
    """r, g, b of a flow vector of length 1 and below (beyond, darkened)."""
    colors = wheel()
    radius, turn = F.sqrt(u * u + v * v), (F.atan2(-v, -u) / math.pi + 1) / 2 * (len(colors) - 1)
    low = F.floor(turn).cast("int")
    out = []
    for channel in range(3):
        table = F.array(*[F.lit(c[channel] / 255) for c in colors])
        mixed = (1 - (turn - low)) * F.get(table, low) + (turn - low) * F.get(table, (low + 1) % len(colors))
        out.append(F.floor(255 * F.when(radius <= 1, 1 - radius * (1 - mixed)).otherwise(mixed * 0.75) + 1e-9).cast("int"))
    return out


def from_ycbcr(y: Column, cb: Column, cr: Column) -> dict[str, Column]:
    """r, g, b (0..255, not clipped) of 8-bit YCbCr."""
    return {c: (a * y + p * cb + q * cr) * 255 + offset for c, (a, p, q, offset) in FROM_YCBCR.items()}


def to_image(value: Column, low: float = 0, high: float = 1) -> Column:
    """A tensor's value as 8 bits: clamped, scaled, rounded half to even."""
    return F.bround((F.least(F.greatest(value, F.lit(low)), F.lit(high)) - low) / (high - low) * 255, 0).cast("int")


def jpeg_factor(quality: int) -> float:
    return (5000 / quality if quality < 50 else 200 - 2 * quality) / 100


def dct_blocks(cells: DataFrame, group: list[str], value: Column, quality: int = 75) -> DataFrame:
    """(group, v, u, coefficient, quantised) of 8 x 8 blocks with cells (y, x): rows first, then columns, each one aggregation."""

    def along(df: DataFrame, place: str, name: str, value: Column, keep: list[str]) -> DataFrame:
        table = F.array(*[F.array(*[F.lit((math.sqrt(0.5) if k == 0 else 1.0) / 2 * math.cos((2 * p + 1) * k * math.pi / 16)) for p in range(8)]) for k in range(8)])
        each = df.withColumn("cell", value).withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(7))))
        return each.groupBy(*keep, name).agg(F.sum(F.col("cell") * F.get(F.get(table, F.col(name)), F.col(place).cast("int"))).alias("part"))

    rows = along(cells, "x", "u", value - 128, [*group, "y"])
    both = along(rows, "y", "v", F.col("part"), [*group, "u"])
    step = F.get(F.array(*[F.lit(float(x)) for x in LUMINANCE]), F.col("v") * 8 + F.col("u")) * jpeg_factor(quality)
    return both.select(*group, "v", "u", F.col("part").alias("coefficient"), (F.col("part") / step).alias("quantised"))


def cubic(x: Column) -> Column:
    a = F.abs(x)
    return F.when(a <= 1, 1.5 * a * a * a - 2.5 * a * a + 1).when(a <= 2, -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2).otherwise(0.0)


def resize_weights(spark, n: int, scale: float) -> DataFrame:
    """(k, x, weight): what input place x (from 0) adds to output place k, cubic with antialiasing, mirrored at the ends."""
    wide = 4 / min(scale, 1)
    taps = math.ceil(wide) + 2
    squeeze = min(scale, 1)
    out = spark.range(math.ceil(n * scale)).withColumn("u", (F.col("id") + 1) / scale + 0.5 * (1 - 1 / scale))
    each = out.select(F.col("id").alias("k"), "u", F.explode(F.sequence(F.lit(0), F.lit(taps - 1))).alias("tap")).withColumn("i", F.floor(F.col("u") - wide / 2) + F.col("tap"))
    each = each.withColumn("w", cubic((F.col("u") - F.col("i")) * squeeze))
    each = each.join(each.groupBy("k").agg(F.sum("w").alias("all")), "k")
    mirrored = F.when(F.col("i") < 1, 1 - F.col("i")).when(F.col("i") > n, 2 * n + 1 - F.col("i")).otherwise(F.col("i")) - 1
    return each.where("w <> 0").groupBy("k", mirrored.alias("x")).agg(F.sum(F.col("w") / F.col("all")).alias("weight"))


def resize_rows(pixels: DataFrame, keep: list[str], value: str, n: int, scale: float) -> DataFrame:
    """Rows of ``n`` pixels resized by ``scale``: a join with the small table of weights, which does not grow with the data."""
    met = pixels.join(F.broadcast(resize_weights(pixels.sparkSession, n, scale)), "x")
    return met.groupBy(*keep, "k").agg(F.sum(F.col(value) * F.col("weight")).alias(value))


def gan_losses(df: DataFrame, by: list[str], x: Column) -> DataFrame:
    """Means of the adversarial losses of predictions ``x``, as for real and for fake ones."""
    softplus = lambda c: F.log1p(F.exp(-F.abs(c))) + F.greatest(c, F.lit(0.0))
    return df.groupBy(*by).agg(
        F.avg(F.greatest(1 - x, F.lit(0.0))).alias("hinge_real"), F.avg(F.greatest(1 + x, F.lit(0.0))).alias("hinge_fake"), (-F.avg(x)).alias("wgan_real"), F.avg(x).alias("wgan_fake"),
        F.avg(softplus(-x)).alias("softplus_real"), F.avg(softplus(x)).alias("softplus_fake"), F.avg((x - 1) * (x - 1)).alias("lsgan_real"), F.avg(x * x).alias("lsgan_fake"),
    )


def reflected(place: Column, n: int) -> Column:
    """``place`` mirrored into 0..n-1, the edge not repeated."""
    return F.when(place < 0, -place).when(place > n - 1, 2 * (n - 1) - place).otherwise(place)


def neighbourhood(pixels: DataFrame, height: int, width: int, reach: int, weight=None) -> DataFrame:
    """Every pixel's values sent to the pixels whose window (2 * reach + 1 square, mirrored at the edges) holds it, with the window's ``weight`` there."""
    offsets = range(-reach, reach + 1)
    weight = weight or (lambda dy, dx: 1.0)
    axis = lambda n, name: pixels.sparkSession.range(n).select(F.col("id").alias(f"t{name}"), F.explode(F.array(*[F.lit(k) for k in offsets])).alias(f"d{name}")).withColumn(name, reflected(F.col(f"t{name}") + F.col(f"d{name}"), n))
    w = F.lit(0.0)
    for dy in offsets:
        for dx in offsets:
            w = F.when((F.col("dy") == dy) & (F.col("dx") == dx), float(weight(dy, dx))).otherwise(w)
    met = pixels.join(F.broadcast(axis(height, "y")), "y").join(F.broadcast(axis(width, "x")), "x")
    return met.select(*[c for c in pixels.columns if c not in ("y", "x")], F.col("ty").alias("y"), F.col("tx").alias("x"), w.alias("weight"))


def artifact_map(pixels: DataFrame, frame: list[str], height: int, width: int, size: int = 7) -> DataFrame:
    """(frame, y, x, weight) of pixels with ``residual`` and ``residual_ema``: local variance times the fifth root of the frame's, 0 where the residual is smaller."""
    local = neighbourhood(pixels, height, width, size // 2).groupBy(*frame, "y", "x").agg(F.var_samp("residual").alias("local"))
    whole = pixels.groupBy(*frame).agg(F.var_samp("residual").alias("whole"))
    met = pixels.join(local, [*frame, "y", "x"]).join(whole, frame)
    return met.select(*frame, "y", "x", F.when(F.col("residual") < F.col("residual_ema"), 0.0).otherwise(F.pow("whole", F.lit(0.2)) * F.col("local")).alias("weight"))


def sharpen(pixels: DataFrame, frame: list[str], height: int, width: int, taps: tuple[float, ...] = (0.25, 0.5, 0.25), weight: float = 0.5, threshold: float = 10) -> DataFrame:
    """Unsharp mask of ``value`` (0..1): residuals over the threshold are added, softly masked."""
    reach = len(taps) // 2
    key = [*frame, "y", "x"]

    def blur(df: DataFrame, name: str) -> DataFrame:
        sent = neighbourhood(df.select(*key, name), height, width, reach, lambda dy, dx: taps[dy + reach] * taps[dx + reach])
        return sent.groupBy(*key).agg(F.sum(F.col(name) * F.col("weight")).alias("soft"))

    first = pixels.join(blur(pixels, "value").withColumnRenamed("soft", "blur"), key).withColumn("residual", F.col("value") - F.col("blur"))
    first = first.withColumn("mask", (F.abs("residual") * 255 > threshold).cast("double"))
    met = first.join(blur(first, "mask"), key)
    sharp = F.least(F.greatest(F.col("value") + weight * F.col("residual"), F.lit(0.0)), F.lit(1.0))
    return met.select(*key, (F.col("soft") * sharp + (1 - F.col("soft")) * F.col("value")).alias("value"))


def ssim_frames(pixels: DataFrame, frame: list[str], a: str, b: str, height: int, width: int, size: int = 11, sigma: float = 1.5) -> DataFrame:
    """(frame, ssim): structural similarity of 8-bit channels ``a`` and ``b`` with a Gaussian window, valid part; rows first, then columns."""
    taps = [math.exp(-((k - size // 2) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    taps = [x / sum(taps) for x in taps]
    sums = ["ma", "mb", "aa", "bb", "ab"]
    now = pixels.select(*frame, "y", "x", F.col(a).cast("double").alias("ma"), F.col(b).cast("double").alias("mb")).withColumns({"aa": F.col("ma") * F.col("ma"), "bb": F.col("mb") * F.col("mb"), "ab": F.col("ma") * F.col("mb")})
    for axis, n, other in (("x", width, "y"), ("y", height, "x")):
        each = now.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("at", F.col(axis) - F.col("k")).where((F.col("at") >= 0) & (F.col("at") <= n - size))
        tap = F.get(F.array(*map(F.lit, taps)), F.col("k"))
        now = each.groupBy(*frame, other, F.col("at")).agg(*[F.sum(F.col(s) * tap).alias(s) for s in sums]).withColumnRenamed("at", axis)
    ma, mb = F.col("ma"), F.col("mb")
    va, vb, cov = F.col("aa") - ma * ma, F.col("bb") - mb * mb, F.col("ab") - ma * mb
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return now.groupBy(*frame).agg(F.avg((2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).alias("ssim"))


def up_fir_down(samples: DataFrame, keep: list[str], place: str, value: str, n: int, up: int, down: int, taps: tuple[float, ...], pad: tuple[int, int]) -> DataFrame:
    """Rows of ``n`` samples with zeros between them, filtered, every ``down``-th kept: each sample is sent to the outputs it reaches."""
    flipped = taps[::-1]
    last = (n * up + sum(pad) - len(taps)) // down
    each = samples.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(taps) - 1)))).withColumn("full", F.col(place) * up - F.col("k") + pad[0])
    each = each.where((F.col("full") % down == 0) & F.col("full").between(0, last * down)).withColumn("part", F.col(value) * F.get(F.array(*map(F.lit, flipped)), F.col("k")))
    return each.groupBy(*keep, F.floor(F.col("full") / down).alias("at")).agg(F.sum("part").alias(value))


def fused_leaky_relu(x: Column, bias: Column, slope: float = 0.2) -> Column:
    return F.when(x + bias > 0, x + bias).otherwise((x + bias) * slope) * math.sqrt(2)


def dhash_rows(pixels: DataFrame, frame: list[str], value: str) -> DataFrame:
    """(frame, y, bits): for each row the signs of the steps to the right, the first pair in the highest bit."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("x", value))), lambda p: p[value])
    rows = pixels.groupBy(*frame, "y").agg(row.alias("row"))
    signs = F.zip_with(F.slice("row", F.lit(2), F.greatest(F.size("row") - 1, F.lit(0))), F.slice("row", F.lit(1), F.greatest(F.size("row") - 1, F.lit(0))), lambda right, left: right > left)
    return rows.select(*frame, "y", F.aggregate(signs, F.lit(0).cast("long"), lambda bits, s: bits * 2 + s.cast("long")).alias("bits"))


def book_grid(spark, names: DataFrame, name: str, index: str) -> DataFrame:
    """(name, slot, y, x): where the screenshot shows the swatches of each name; after GRID['rows'] names a second block of columns begins."""
    later = (F.col(index) >= GRID["rows"]).cast("long")
    each = names.select(name, index, F.explode(F.sequence(F.lit(0), F.lit(GRID["slots"] - 1))).alias("slot"))
    y = GRID["h"] + (F.col(index) - later * GRID["rows"]) * GRID["delta_h"]
    x = GRID["w"] + (F.col("slot") + later * GRID["slots"]) * GRID["delta_w"]
    return each.select(name, "slot", y.alias("y"), x.alias("x"))


def book_line(name: Column, slots: Column) -> Column:
    """A colour book's line: ``name: [[r g b],null,...]`` of an array of colours."""
    return F.concat(name, F.lit(": ["), F.array_join(F.transform(slots, lambda c: F.when(c.isNull(), "null").otherwise(F.concat(F.lit("["), F.array_join(c.cast("array<string>"), " "), F.lit("]")))), ","), F.lit("]"))


def parse_book_line(line: Column) -> dict[str, Column]:
    """name and slots (array of colours, null where the book has none) of a colour book's line."""
    body = F.regexp_extract(line, r"^[^:]*: \[(.*)\]$", 1)
    slots = F.transform(F.split(body, ","), lambda s: F.when(s != "null", F.split(F.regexp_replace(s, r"[\[\]]", ""), " ").cast("array<int>")))
    return {"name": F.regexp_extract(line, r"^([^:]*): ", 1), "slots": slots}
