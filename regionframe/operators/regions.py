"""Region-labelled pixels and groups: modes, geometry, relabelling, connected components, thinning, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .ordering import numbered


def mode_per_group(df: DataFrame, group: list[str], value: list[str]) -> DataFrame:
    """Most frequent value; ties go to the smallest. One aggregation over counts instead of a sort."""
    counts = df.groupBy(*group, *value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("m"), *value)).alias("x"))
    return best.select(*group, *[F.col(f"x.{v}").alias(v) for v in value], (-F.col("x.m")).alias("n"))


def first_per_group(df: DataFrame, group: list[str], value: str, order: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.min_by(value, F.struct(*order)).alias(value))


def geometry(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Bounding box, centre and number of cells of each group."""
    return df.groupBy(*group).agg(
        F.min(x).alias("xmin"), F.max(x).alias("xmax"), F.min(y).alias("ymin"), F.max(y).alias("ymax"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.count("*").alias("npix")
    )


def dense_relabel(df: DataFrame, partition: list[str], order: list[str], name: str = "new_label") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def relabel_by_first_pixel(pixels: DataFrame, frame: list[str]) -> DataFrame:
    """(frame, label, new_label): labels numbered by their first pixel, row then column; 0 stays."""
    tops = pixels.where("label <> 0").groupBy(*frame, "label").agg(F.min(F.struct("y", "x")).alias("top"))
    return dense_relabel(tops, frame or [F.lit(0)], ["top", "label"]).select(*frame, "label", "new_label")


def frequency_rank(df: DataFrame, value: str, order: str) -> DataFrame:
    """Rank of values by count, first seen first on ties, from 0."""
    stats = df.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    return numbered(stats, [F.desc("n"), "seen"], "rank")


def count_with_gaps(df: DataFrame, value: str, least: int, most: int) -> DataFrame:
    """Counts of all values from ``least`` to ``most``, zeros included."""
    axis = df.sparkSession.range(least, most + 1).withColumnRenamed("id", value)
    return axis.join(df.groupBy(F.col(value).cast("long").alias(value)).agg(F.count("*").alias("n")), value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"))


def keep_large(groups: DataFrame, size: str, rule: str) -> DataFrame:
    """Groups at least as large as the mean, median or maximum of all sizes."""
    how = {"mean": F.avg(size), "median": F.median(size), "max": F.max(size)}[rule]
    return groups.join(F.broadcast(groups.agg(how.cast("double").alias("bar"))), F.col(size) >= F.col("bar"))


def runs(cells: DataFrame, frame: list[str]) -> DataFrame:
    """Row runs (x0..x1) of filled cells."""
    w = Window.partitionBy(*frame, "y").orderBy("x")
    return cells.withColumn("island", F.col("x") - F.row_number().over(w)).groupBy(*frame, "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def components(cells: DataFrame, frame: list[str], diagonal: bool = False) -> DataFrame:
    """(frame, y, x0, x1, component): connected runs, numbered by their first cell in row-major order.

    Runs are nodes; the least run spreads over overlaps in the neighbouring rows, and labels jump to their label's label.
    """
    reach = 1 if diagonal else 0
    r = cut(runs(cells, frame).withColumn("id", F.struct(*frame, "y", "x0")))
    a, b = (r.select(*[F.col(c).alias(f"{s}_{c}") for c in [*frame, "y", "x0", "x1", "id"]]) for s in "ab")
    on = [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in frame] + [F.col("a_y") + 1 == F.col("b_y"), F.col("a_x0") <= F.col("b_x1") + reach, F.col("b_x0") <= F.col("a_x1") + reach]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    edges = a.join(b, cond).select(F.col("a_id").alias("u"), F.col("b_id").alias("v"))
    edges = cut(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    label = cut(r.select("id", F.col("id").alias("label")))
    while True:
        near = edges.join(label, F.col("v") == F.col("id")).groupBy("u").agg(F.min("label").alias("near"))
        step = label.join(near, F.col("id") == F.col("u"), "left").select("id", F.least("label", F.coalesce("near", "label")).alias("to"), "label")
        jump = step.select("id", "to", "label").join(label.select(F.col("id").alias("t"), F.col("label").alias("further")), F.col("to") == F.col("t"))
        now = cut(jump.select("id", F.least("to", "further").alias("label"), (F.least("to", "further") != F.col("label")).alias("moved")))
        label = now.select("id", "label")
        if now.where("moved").isEmpty():
            break
    roots = label.select("label", *[F.col(f"label.{c}").alias(c) for c in frame]).distinct()
    numbered = roots.withColumn("component", F.row_number().over(Window.partitionBy(*(frame or [F.lit(0)])).orderBy("label"))).select(F.col("label").alias("root"), "component")
    return r.join(label, "id").join(numbered, F.col("label") == F.col("root")).select(*frame, "y", "x0", "x1", "component")


NEIGHBOURS = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))  # W NW N NE E SE S SW


def thin_round(cells: DataFrame, frame: list[str], strict_border: bool = True) -> DataFrame:
    """One synchronous round: a line cell (label 0) beside a labelled one takes the first labelled neighbour, W first, clockwise.

    Beside means a 4-neighbour; the label may then come from any of the eight. Labelled cells are sent to their neighbours, so that one aggregation
    replaces eight joins. ``strict_border``: nothing is read from column 0 to the west or from row 0 to the north.
    """
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(NEIGHBOURS)])
    sent = cells.where("label <> 0").select(*frame, "x", "y", "label", F.explode(steps).alias("d"))
    read = F.lit(True) if not strict_border else ~(((F.col("d.dx") == -1) & (F.col("x") == 0)) | ((F.col("d.dy") == -1) & (F.col("y") == 0)))
    sent = sent.withColumn("got", F.when(read, F.struct(F.col("d.k").alias("k"), "label"))).withColumn("beside", F.abs("d.dx") + F.abs("d.dy") == 1)
    sent = sent.groupBy(*frame, (F.col("x") - F.col("d.dx")).alias("x"), (F.col("y") - F.col("d.dy")).alias("y")).agg(F.min("got").alias("got"), F.bool_or("beside").alias("beside"))
    key = [*frame, "x", "y"]
    taken = F.when(F.col("beside"), F.coalesce("got.label", F.lit(0))).otherwise(0)
    return cells.join(sent, key, "left").select(*key, F.when(F.col("label") == 0, taken).otherwise(F.col("label")).alias("label"))


def thin(cells: DataFrame, frame: list[str], rounds: int = 100) -> DataFrame:
    """Rounds of thinning until no line cell changes; like the operator it follows, at most ``rounds``."""
    left, now = None, cut(cells.select(*frame, "x", "y", "label"))
    for _ in range(rounds):
        now = cut(thin_round(now, frame))
        before, left = left, now.where("label = 0").count()
        if left in (0, before):
            break
    return now


def adjacency(cells: DataFrame, frame: list[str], diagonal: bool = True) -> DataFrame:
    """Distinct (frame, label, other) of touching cells with different labels."""
    steps = [s for s in NEIGHBOURS if diagonal or 0 in s]
    sent = cells.select(*frame, F.col("label").alias("other"), "x", "y", F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps])).alias("d"))
    sent = sent.select(*frame, "other", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"))
    return cells.join(sent, [*frame, "x", "y"]).where("label <> other").select(*frame, "label", "other").distinct()


def erase_small(cells: DataFrame, frame: list[str], limit: int) -> DataFrame:
    """(frame, label, target): regions of at most ``limit`` cells go to their smallest neighbour (then least label), by areas at the start; without one to the line, 0."""
    sizes = cells.where("label <> 0").groupBy(*frame, "label").agg(F.count("*").alias("n"))
    near = adjacency(cells.where("label <> 0"), frame).join(sizes.select(*frame, F.col("label").alias("other"), F.col("n").alias("m")), [*frame, "other"])
    best = near.groupBy(*frame, "label").agg(F.min(F.struct("m", "other"))["other"].alias("other"))
    return sizes.join(best, [*frame, "label"], "left").select(*frame, "label", "n", F.when(F.col("n") <= limit, F.coalesce("other", F.lit(0))).otherwise(F.col("label")).alias("target"))


def merge_colour_lines(cells: DataFrame, frame: list[str], marks: tuple[int | None, ...] = (0, 2, None)) -> tuple[DataFrame, DataFrame]:
    """Coloured line pieces become parts of regions: (cells with their new labels, (frame, label, mark, kind) of the marked regions).

    ``cells`` holds frame, x, y, label (0: line) and ``kind``, the place of a line colour in ``marks`` or null.  Kinds are taken in turn.  A piece
    (8-connected, one kind) with several regions at its sides joins the smallest (then least label) and marks it; with one region or nothing
    at its sides it is a new region, marked 0; beside nothing but regions that earlier pieces made it goes to the line, 0.
    Areas are those at the start.  Pieces of one kind never touch, so that a kind is one step for all frames and pieces.
    """
    key, now, marked = [*frame, "x", "y"], cells.select(*frame, "x", "y", "label", "kind"), None
    areas = cut(cells.where("label <> 0").groupBy(*frame, "label").agg(F.count("*").alias("area")))
    cross = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in NEIGHBOURS if 0 in (dx, dy)])
    for k, mark in enumerate(marks):
        runs_of = components(now.where(F.col("kind") == k).select(*key), frame, diagonal=True)
        piece = cut(runs_of.select(*frame, F.explode(F.sequence("x0", "x1")).alias("x"), "y", "component"))
        beside = piece.select(*frame, "component", "x", "y", F.explode(cross).alias("d")).select(*frame, "component", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"))
        near = now.where((F.col("label") != 0) & ~F.col("kind").eqNullSafe(F.lit(k))).join(beside.distinct(), key).select(*frame, "component", "label").distinct()
        near = near.join(areas, [*frame, "label"], "left").groupBy(*frame, "component")
        near = near.agg(F.count("area").alias("regions"), F.min(F.when(F.col("area").isNotNull(), F.struct("area", "label")))["label"].alias("least"))
        found = piece.select(*frame, "component").distinct().join(near, [*frame, "component"], "left")
        # regions: null beside nothing, 0 beside new regions only
        found = found.withColumn("new", F.coalesce(F.col("regions"), F.lit(1)) == 1)
        place = F.row_number().over(Window.partitionBy(*(frame or [F.lit(0)]), "new").orderBy("component"))
        top = now.groupBy(*frame).agg(F.max("label").alias("top"))
        found = found.withColumn("place", place).join(top, frame) if frame else found.withColumn("place", place).crossJoin(top)  # without frames ``top`` is one row
        label = F.when(F.col("new"), F.col("top") + F.col("place")).when(F.col("regions") == 0, 0).otherwise(F.col("least")).cast("long")
        found = cut(found.select(*frame, "component", label.alias("to"), F.when(F.col("new"), 0).otherwise(F.lit(mark)).alias("mark")))
        step = found.where("to <> 0 and mark is not null").select(*frame, F.col("to").alias("label"), F.col("mark").cast("int").alias("mark"), F.lit(k).alias("kind"))
        marked = step if marked is None else marked.unionByName(step)
        moved = piece.join(found.select(*frame, "component", "to"), [*frame, "component"]).select(*key, "to")
        now = cut(now.join(moved, key, "left").select(*key, F.coalesce("to", "label").alias("label"), "kind"))
    last = marked.groupBy(*frame, "label").agg(F.max(F.struct("kind", "mark")).alias("last"))
    return now, last.select(*frame, "label", "last.mark", "last.kind")


def splat(df: DataFrame, group: list[str], x: Column, y: Column, value: str, order: str) -> DataFrame:
    """Values at rounded places, the last writer wins."""
    return df.groupBy(*group, F.bround(x, 0).cast("long").alias("x"), F.bround(y, 0).cast("long").alias("y")).agg(F.max_by(value, order).alias(value), F.count("*").alias("writers"))
