"""Scalar functions: names and paths, literals, label codes, colours, quantisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def natural_key(s: Column, width: int = 12) -> Column:
    """A sort key under which f2 < f9 < f10: runs of digits are padded."""
    runs = F.regexp_extract_all(s, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, width, "0")).otherwise(x)), "")


def trailing_int(s: Column) -> Column:
    """The number at the end of a name; null where there is none."""
    return F.regexp_extract(s, r"(\d+)$", 1).try_cast("int")


def path_parts(p: Column) -> dict[str, Column]:
    base = F.element_at(F.split(p, "/"), -1)
    return {"base": base, "stem": F.regexp_replace(base, r"\.[^.]*$", ""), "ext": F.regexp_extract(base, r"\.([^.]*)$", 1), "depth": F.size(F.split(p, "/"))}


def human_size(n: Column) -> Column:
    """Size in steps of 1024 with one digit after the point."""
    v = n.cast("double")
    units = ["B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB"]
    out = F.concat(F.round(v / 1024.0 ** len(units), 1).cast("string"), F.lit(" YB"))
    for k, unit in reversed(list(enumerate(units))):
        out = F.when(F.abs(v) < 1024.0 ** (k + 1), F.concat(F.round(v / 1024.0**k, 1).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def duration(seconds: Column) -> Column:
    """Whole seconds as ``[D day[s], ]H:MM:SS``."""
    days = F.floor(seconds / 86400)
    head = F.when(days > 1, F.concat(days.cast("string"), F.lit(" days, "))).when(days == 1, "1 day, ").otherwise("")
    return F.concat(head, F.format_string("%d:%02d:%02d", F.floor(seconds % 86400 / 3600), F.floor(seconds % 3600 / 60), seconds % 60))


def parse_literal(s: Column) -> dict[str, Column]:
    """What a configuration value reads as: null, boolean, integer, float or text; never evaluated."""
    low = F.lower(s)
    kind = F.when(low.isin("none", "null", "~"), "null").when(low.isin("true", "false"), "bool").when(s.rlike(r"^[+-]?\d+$"), "int").when(s.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "float").otherwise("text")
    return {"kind": kind, "number": F.when(kind.isin("int", "float"), s.try_cast("double"))}


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16) + F.shiftleft(g.cast("int"), 8) + b.cast("int")


def unpack_rgb(label: Column) -> tuple[Column, Column, Column]:
    v = label.cast("int")
    return F.shiftright(v, 16).bitwiseAND(255), F.shiftright(v, 8).bitwiseAND(255), v.bitwiseAND(255)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def quantize(x: Column, lo: float, hi: float, levels: int) -> Column:
    clipped = F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    return F.least(F.floor((clipped - lo) * levels / (hi - lo)), F.lit(levels - 1)).cast("long")


def dequantize(q: Column, lo: float, hi: float, levels: int) -> Column:
    return (q + 0.5) * (hi - lo) / levels + lo


def ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """BT.601 studio range of 8-bit colours, rounded half to even."""
    rows = ((65.481, 128.553, 24.966, 16.0), (-37.797, -74.203, 112.0, 128.0), (112.0, -93.786, -18.214, 128.0))
    return tuple(F.bround((r * a + g * c + b * d) / 255.0 + e, 0).cast("int") for a, c, d, e in rows)


def is_line(r: Column, g: Column, b: Column, a: Column | None = None) -> Column:
    """Line art: opaque enough where there is an alpha channel, else dark."""
    return (a > 100) if a is not None else (r + g + b) / 3.0 < 150


def blend(line: Column, alpha: Column, below: Column) -> Column:
    """A line colour over a fill by alpha 0..255."""
    return F.bround((line * alpha + below * (255 - alpha)) / 255.0, 0).cast("int")


def flow_from_png(v: Column) -> Column:
    return (v - 32768) / 64.0


def color_cube(spark: SparkSession, steps: int) -> DataFrame:
    """Evenly spaced colours, red outermost."""
    axis = spark.range(steps).select(F.floor((F.col("id") * 255) / max(steps - 1, 1)).cast("int").alias("v"))
    r, g, b = (axis.withColumnRenamed("v", c) for c in "rgb")
    return r.join(g, how="cross").join(b, how="cross")


def multistep_lr(step: Column, base: float, milestones: list[int], gamma: float) -> Column:
    passed = sum((F.when(step >= m, 1).otherwise(0) for m in milestones[1:]), F.when(step >= milestones[0], 1).otherwise(0))
    return base * F.pow(F.lit(gamma), passed)


def warmup_lr(step: Column, lr: Column, warm: int) -> Column:
    return F.when(step < warm, lr * step / float(warm)).otherwise(lr)


def cosine_lr(step: Column, base: float, floor: float, periods: list[int], weights: list[float]) -> Column:
    """Cosine annealing with restarts: the period that ends at or after the step counts."""
    out, start = F.lit(floor), 0
    spans = []
    for n, w in zip(periods, weights):
        spans.append((start, n, w))
        start += n
    for begin, n, w in reversed(spans):
        wave = F.lit(floor) + F.lit(w * 0.5 * (base - floor)) * (1 + F.cos(F.lit(3.141592653589793) * ((step - begin) / float(n))))
        out = F.when(step <= begin + n, wave).otherwise(out)
    return out
