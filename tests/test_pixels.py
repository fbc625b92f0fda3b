"""Pixel operators, kernels and sources that have no SQL, against literal versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionframe.functions import named
from regionframe.operators import kernels, ordering, pixels, quality, regions, series
from regionframe.sources import files
from regionframe.sources.rasters import decode_png, encode_png


def literal_thin(grid, rounds=100):
    """Thinning as it is described: line cells beside a label look W, NW, N, NE, E, SE, S, SW; nothing to the west or north is read from column or row 0."""
    h, w = grid.shape
    for _ in range(rounds):
        now = grid.copy()
        for y in range(h):
            for x in range(w):
                beside = any(0 <= y + b < h and 0 <= x + a < w and grid[y + b, x + a] for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))
                if grid[y, x] or not beside:
                    continue
                for a, b in regions.NEIGHBOURS:
                    if (a == -1 and x - 1 <= 0) or (b == -1 and y - 1 <= 0) or x + a >= w or y + b >= h:
                        continue
                    if grid[y + b, x + a]:
                        now[y, x] = grid[y + b, x + a]
                        break
        if (now == grid).all():
            break
        grid = now
    return grid


def test_thinning(spark):
    rng = np.random.default_rng(3)
    grid = rng.integers(0, 9, (14, 15)) * (rng.random((14, 15)) < 0.15)
    cells = spark.createDataFrame([(0, x, y, int(grid[y, x])) for y in range(14) for x in range(15)], "frame int, x int, y int, label int")
    got = {(r.y, r.x): r.label for r in regions.thin(cells, ["frame"]).collect()}
    want = literal_thin(grid)
    assert got == {(y, x): want[y, x] for y in range(14) for x in range(15)}


def literal_ball(left, radius):
    """Seeds one by one: the first cell whose ball is free, everything such centres reach by steps of one, and all that their balls cover."""
    h, w = left.shape
    ball = [(b, a) for b in range(-radius, radius + 1) for a in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    left, fills = left.copy(), []
    while True:
        free = [(y, x) for y in range(h) for x in range(w) if all(not (0 <= y + b < h and 0 <= x + a < w) or left[y + b, x + a] for b, a in ball)]
        if not free:
            return fills
        todo, seen, free = [free[0]], {free[0]}, set(free)
        while todo:
            y, x = todo.pop()
            for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if p in free and p not in seen:
                    seen.add(p)
                    todo.append(p)
        fill = np.zeros((h, w), bool)
        for y, x in seen:
            for b, a in ball:
                if 0 <= y + b < h and 0 <= x + a < w:
                    fill[y + b, x + a] = True
        fills.append(fill & left)
        left &= ~fill


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_ball_fills(radius):
    rng = np.random.default_rng(radius)
    for _ in range(4):
        free = rng.random((22, 25)) > 0.06
        got, want = kernels.ball_fills(free, radius), literal_ball(free, radius)
        assert len(got) == len(want) and all((a == b).all() for a, b in zip(got, want))
    labels = kernels.trapped_ball(free, (3, 2, 1), ("max", "mean", "mean"))
    assert ((labels > 0) == free).all()


def test_spread_colors():
    rng = np.random.default_rng(2)
    colors, fixed = rng.integers(0, 256, (12, 3)), np.array([1] + [0] * 11)
    start = [list(c / 255) for c in colors] + [[0.0] * 3]
    now, pace = [list(c) for c in start], 0.003
    for _ in range(39):
        after = []
        for i, p in enumerate(now):
            near = min((j for j in range(13) if j != i), key=lambda j: math.dist(p, now[j]))
            gap = math.dist(p, now[near])
            after.append(start[i] if i == 12 or fixed[i] else [min(max(a + pace * (a - b) / gap, 0.1), 0.9) for a, b in zip(p, now[near])])
        now, pace = after, pace * 0.99
    assert (kernels.spread(colors, fixed) == np.round(255 * np.array(now[:-1])).astype(int)).all()


def test_frechet(spark):
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((60, 5)), rng.standard_normal((70, 5)) @ np.diag([1, 2, 3, 1, 1]) + 1
    d = spark.createDataFrame([(0, x.tolist()) for x in a] + [(1, x.tolist()) for x in b], "k int, v array<double>")
    c, e = np.cov(a.T), np.cov(b.T)
    w = np.sqrt(np.maximum(np.linalg.eigvals(c @ e).real, 0)).sum()
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(c) + np.trace(e) - 2 * w
    assert quality.frechet(d, "k", "v", 0, 1).first()[0] == pytest.approx(want, rel=1e-9)


def test_numbers_without_one_task(spark):
    rows = [(k * 7919 % 1009, "hot" if k % 3 else f"g{k % 5}") for k in range(1009)]
    d = spark.createDataFrame(rows, "v long, g string").repartition(5)
    assert {(r.v, r.n) for r in ordering.numbered(d, ["v"], "n").collect()} == {(v, v) for v in range(1009)}
    got = {(r.g, r.v): r.n for r in ordering.numbered(d, ["v"], "n", within=["g"]).collect()}
    for g in {g for _, g in rows}:
        assert [got[g, v] for v in sorted(v for v, h in rows if h == g)] == list(range(sum(h == g for _, h in rows)))


def test_smoothing_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(series, "CHUNK", 16)
    d = spark.range(200).select((F.col("id") % 3).alias("g"), "id", F.sin("id").alias("v"))
    got = {(r.g, r.id): r.smooth for r in series.ema(d, ["g"], "id", "v", 0.6).collect()}
    for g in range(3):
        last = None
        for k in range(g, 200, 3):
            last = math.sin(k) if last is None else last * 0.6 + math.sin(k) * 0.4
            assert got[g, k] == pytest.approx(last, abs=1e-12)


def test_names():
    names = named.Names("thing")

    def one():
        return 1

    assert names.add(one) is one and names.find("one")() == 1 and "one" in names
    names.add(one, suffix="regionframe")
    with pytest.raises(KeyError):
        names.add(one)
    with pytest.raises(KeyError):
        names.find("two")


def test_losses_reduce(spark):
    d = spark.createDataFrame([(0.0, 1.0, 1.0), (2.0, 1.0, 0.0), (3.0, 1.0, 1.0)], "p double, t double, w double")
    l1 = named.LOSSES.find("l1")
    p, t, w = (F.col(c) for c in "ptw")
    assert d.agg(l1(p, t), l1(p, t, w), l1(p, t, w, reduction="sum")).first()[:] == (pytest.approx(4 / 3), 1.5, 3.0)
    assert [r[0] for r in d.select(l1(p, t, reduction="none")).collect()] == [1, 1, 2]


def test_files(spark, tmp_path):
    grid = np.arange(12, dtype=np.int64).reshape(3, 4)
    np.save(tmp_path / "a.npy", grid)
    labels = np.array([[0, 1, -1], [70_000, 255, 256]])
    (tmp_path / "l.png").write_bytes(encode_png(files.label_image(labels)))
    (tmp_path / ".hidden.png").write_bytes(b"")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.npy").write_bytes((tmp_path / "a.npy").read_bytes())
    assert {r.name for r in files.listed(spark, str(tmp_path), (".npy",)).collect()} == {"a.npy"}
    assert {r.name for r in files.listed(spark, str(tmp_path), recursive=True).collect()} == {"a.npy", "b.npy", "l.png"}
    assert {(r.y, r.x): r.value for r in files.read_npy(spark, str(tmp_path)).collect()} == {(y, x): grid[y, x] for y in range(3) for x in range(4)}
    read = files.read_labels(spark, str(tmp_path), "l.png")
    assert {(r.y, r.x): r.value for r in read.collect()} == {(y, x): labels[y, x] for y in range(2) for x in range(3)}
    written = files.label_files(read.withColumn("frame", F.lit(7)), "frame").first()
    assert written.frame == 7 and (files.labels_of(decode_png(bytes(written.content))) == labels).all()
    files.write_text(spark.createDataFrame([(2, "b"), (1, "a")], "k int, line string"), ["k"], str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a", "b"]


def test_wheel_and_ssim(spark):
    assert len(pixels.wheel()) == 55 and pixels.wheel()[0] == (255, 0, 0) and pixels.wheel()[15] == (255, 255, 0)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, (16, 18)), rng.integers(0, 256, (16, 18))
    d = spark.createDataFrame([(0, y, x, int(a[y, x]), int(b[y, x])) for y in range(16) for x in range(18)], "f int, y int, x int, a int, b int")
    assert pixels.ssim_frames(d, ["f"], "a", "b", 16, 18).first().ssim == pytest.approx(kernels.ssim_window(a, b), abs=1e-9)


def literal_colour_lines(grid, kinds, marks=(0, 2, None)):
    grid, found = [list(row) for row in grid], {}
    high, wide = len(grid), len(grid[0])
    area = {}
    for row in grid:
        for v in row:
            area[v] = area.get(v, 0) + (v != 0)
    area.pop(0, None)
    for k, mark in enumerate(marks):
        seen = set()
        for y in range(high):
            for x in range(wide):
                if kinds[y][x] != k or (y, x) in seen:
                    continue
                piece, queue = set(), [(y, x)]
                while queue:
                    a, b = queue.pop()
                    if (a, b) in piece or not (0 <= a < high and 0 <= b < wide) or kinds[a][b] != k:
                        continue
                    piece.add((a, b))
                    queue += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
                seen |= piece
                rim = {(a + i, b + j) for a, b in piece for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))} - piece
                near = {grid[a][b] for a, b in rim if 0 <= a < high and 0 <= b < wide} - {0}
                old = [v for v in near if v in area]
                if near and not old:
                    to = 0
                elif len(old) < 2:
                    to = max(map(max, grid)) + 1
                    found[to] = 0
                else:
                    to = min(old, key=lambda v: (area[v], v))
                    if mark is not None:
                        found[to] = mark
                for a, b in piece:
                    grid[a][b] = to
    return grid, found


def test_colour_lines(spark):
    rng = np.random.default_rng(12)
    want_cells, want_marks, rows = set(), set(), []
    for frame in range(6):
        label = np.kron(np.arange(1, 10).reshape(3, 3), np.ones((5, 5), int))
        line = rng.random(label.shape) < (0.3 if frame < 4 else 0.7)
        kinds = np.where(line, rng.integers(0, 4, label.shape), 3)
        label = np.where(line, 0, label)
        grid, found = literal_colour_lines(label.tolist(), kinds.tolist())
        for y, x in np.ndindex(label.shape):
            rows.append((frame, x, y, int(label[y, x]), int(kinds[y, x]) if kinds[y, x] < 3 else None))
            want_cells.add((frame, x, y, grid[y][x]))
        want_marks |= {(frame, v, m) for v, m in found.items()}
    now, marks = regions.merge_colour_lines(spark.createDataFrame(rows, "frame int, x int, y int, label long, kind int"), ["frame"])
    assert {(r.frame, r.x, r.y, r.label) for r in now.collect()} == want_cells
    assert {(r.frame, r.label, r.mark) for r in marks.collect()} == want_marks


def test_bests_go_on_over_batches(spark, tmp_path):
    import pandas as pd

    from regionframe.streaming.streams import _rising

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state = State()
    one = pd.DataFrame({"event_id": [2, 1, 3], "at": [2, 1, 3], "value": [5.0, 3.0, 4.0]})
    two = pd.DataFrame({"event_id": [4, 5, 6, 7], "at": [4, 5, 6, 7], "value": [4.5, None, 6.0, 5.5]})
    got = [next(_rising((9,), iter([part]), state))["event_id"].tolist() for part in (one, two)]
    assert got == [[1, 2], [6]] and state.get == (6.0,)
    assert next(_rising((9,), iter([two.assign(value=None)]), state)).empty and state.get == (6.0,)


def test_outlines_and_corners():
    square = np.zeros((30, 30), bool)
    square[3:23, 4:24] = True
    path = kernels.outline(square)
    assert len(path) == 76 and len({tuple(p) for p in path}) == 76 and kernels.corners(path) == 4
    assert (np.abs(np.diff(np.vstack([path, path[:1]]), axis=0)).max(1) == 1).all()
    cross = np.zeros((15, 15), bool)
    cross[5:10] = cross[:, 5:10] = True
    assert kernels.corners(kernels.outline(cross)) >= 8  # the four notches stay
    y, x = np.mgrid[:30, :30]
    assert kernels.corners(kernels.outline((y >= x) & (y < 25))) == 3
    assert kernels.outline(np.ones((1, 1), bool)).tolist() == [[0, 0]] and kernels.corners(kernels.outline(np.ones((1, 2), bool))) == 2
    two = np.zeros((9, 9), bool)
    two[0, 0] = two[5, 5:8] = True
    assert {tuple(p) for p in kernels.outline(two)} == {(5, 5), (5, 6), (5, 7)}


def test_fills_are_merged():
    fill = np.full((60, 80), 1)
    fill[:, 40] = 0
    fill[:, 41:] = 2
    fill[5:25, 5:25] = 3  # a square of 400 cells: 4 corners
    fill[35:50, 5:20] = 1
    fill[40:45, 5:20] = fill[35:50, 10:15] = 4  # a cross of 125 cells with one neighbour
    want = np.full((60, 80), 1)
    want[:, 40] = 0
    want[:, 41:] = 2
    assert (kernels.merge_fills(fill) == want).all()
    edge = np.full((40, 40), 1)
    edge[:, 20:] = 2
    edge[10:25, 18:23] = edge[15:20, 13:28] = 5  # a cross between two fills has many corners: it stays
    assert (kernels.merge_fills(edge) == edge).all()
    edge[10:25, 13:28] = 5  # as a square it goes to the least label
    got = kernels.merge_fills(edge)
    assert set(got[10:25, 13:28].ravel().tolist()) == {1}
    alone = np.zeros((20, 20), int)
    alone[2, 2:6], alone[8, 2:8] = 1, 2  # 4 and 6 cells between lines
    assert np.unique(kernels.merge_fills(alone)).tolist() == [0, 2]
    assert (kernels.merge_fills(np.zeros((3, 3), int)) == 0).all()
