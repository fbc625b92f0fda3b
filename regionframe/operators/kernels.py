"""Per-frame numpy kernels for what is sequential inside one frame: trapped-ball filling and morphology.

A frame is one group; groups are frames, so their size does not grow with the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Steps to the cells around one, clockwise from the west; (dy, dx).
AROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def disk(radius: int) -> np.ndarray:
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    return x * x + y * y <= radius * radius


def dilate(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    ry, rx = shape.shape[0] // 2, shape.shape[1] // 2
    wide = np.pad(mask, ((ry, ry), (rx, rx)))
    out = np.zeros_like(mask)
    for dy, dx in zip(*np.nonzero(shape)):
        out |= wide[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
    return out


def erode(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Outside the frame counts as filled."""
    return ~dilate(~mask, shape[::-1, ::-1])


def label4(mask: np.ndarray) -> np.ndarray:
    """4-connected components of a mask, numbered from 1 by first cell in row-major order."""
    h, w = mask.shape
    label = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    while True:
        low = label.copy()
        for a, b in ((np.s_[1:, :], np.s_[:-1, :]), (np.s_[:, 1:], np.s_[:, :-1])):
            low[a] = np.where(mask[a], np.minimum(low[a], low[b]), low[a])
            low[b] = np.where(mask[b], np.minimum(low[b], low[a]), low[b])
        flat = np.append(low.ravel(), h * w)
        low = np.where(mask, flat[low], h * w)  # a label points to its own cell's label
        if (low == label).all():
            break
        label = low
    roots = np.unique(label[mask])
    return np.where(mask, np.searchsorted(roots, label) + 1, 0)


def ball_fills(left: np.ndarray, radius: int, most: int = 1000) -> list[np.ndarray]:
    """What a ball of ``radius`` fills, one seed after the other: the first place where the ball still fits, all it can reach from there, and again in the rest."""
    ball, left, out = disk(radius), left.copy(), []
    for _ in range(most):
        core = erode(left, ball)
        if not core.any():
            break
        number = label4(core)
        fill = dilate(number == number.ravel()[core.ravel().argmax()], ball) & left
        left &= ~fill
        out.append(fill)
    return out


def trapped_ball(free: np.ndarray, radii: tuple[int, ...], keep: tuple[str, ...] | str = "mean") -> np.ndarray:
    """Labels of regions that a ball of each radius can fill, largest radius first; then what is left by plain components.

    A radius keeps its fills that are at least as large as the ``keep`` statistic (max, mean, median; one for all or one a radius) of them.
    """
    out, left = np.zeros(free.shape, np.int64), free.copy()
    rules = (keep,) * len(radii) if isinstance(keep, str) else keep
    for radius, rule in zip(radii, rules):
        fills = ball_fills(left, radius)
        if not fills:
            continue
        sizes = np.array([f.sum() for f in fills])
        bar = {"max": np.max, "mean": np.mean, "median": np.median}[rule](sizes)
        for f, n in zip(fills, sizes):
            if n >= bar:
                out[f] = out.max() + 1
                left &= ~f
    rest = label4(left)
    out[left] = rest[left] + out.max()
    return out


def outline(mask: np.ndarray) -> np.ndarray:
    """(y, x) of the outer border, in order around the piece of ``mask`` (8-connected) whose first cell, by rows, comes last."""
    body = np.pad(mask, 1)
    cells, seen = np.argwhere(body), np.zeros(body.shape, bool)
    start = cells[0]
    for cell in cells:
        if not seen[tuple(cell)]:
            start, queue = cell, [tuple(cell)]
            while queue:
                y, x = queue.pop()
                if body[y, x] and not seen[y, x]:
                    seen[y, x] = True
                    queue += [(y + dy, x + dx) for dy, dx in AROUND]
    path, at, came = [tuple(start)], tuple(start), 0  # entered from the west
    ended = None
    while True:
        turns = [(came + k) % 8 for k in range(1, 9)]
        step = next((k for k in turns if body[at[0] + AROUND[k][0], at[1] + AROUND[k][1]]), None)
        if step is None or (at, step) == ended:
            break
        ended = ended or (at, step)
        at = (at[0] + AROUND[step][0], at[1] + AROUND[step][1])
        path.append(at)
        came = (step + 6) // 2 * 2 % 8  # go on from the last empty cell that was passed
    return np.array(path[:-1] if len(path) > 1 else path) - 1


def corners(path: np.ndarray, part: float = 0.02) -> int:
    """Corners of a closed outline after dropping points nearer to the chords than ``part`` of its length (Douglas and Peucker)."""
    if len(path) < 3:
        return len(path)
    ring = np.vstack([path, path[:1]]).astype(float)
    bar = part * np.sqrt((np.diff(ring, axis=0) ** 2).sum(1)).sum()
    a = int(((path - path[0]) ** 2).sum(1).argmax())
    path = np.roll(path, -a, axis=0)  # begins at the point farthest from the first; splits at the one farthest from it
    b = int(((path - path[0]) ** 2).sum(1).argmax())
    ring, kept, parts = np.vstack([path, path[:1]]).astype(float), 2, [(0, b), (b, len(path))]
    while parts:
        lo, hi = parts.pop()
        if hi - lo < 2:
            continue
        chord, off = ring[hi] - ring[lo], ring[lo + 1 : hi] - ring[lo]
        size = np.hypot(*chord)
        far = np.abs(off[:, 0] * chord[1] - off[:, 1] * chord[0]) / size if size else np.hypot(off[:, 0], off[:, 1])
        k = int(far.argmax())
        if far[k] > bar:
            kept += 1
            parts += [(lo, lo + 1 + k), (lo + 1 + k, hi)]
    return kept


def merge_fills(fill: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Fills (0: line) that are small or simple take the least label beside them, in the order of labels; until no label goes, ``rounds`` at most.

    Taken in are fills under 50 cells, under 250 with one neighbour, and under 500 with 2 to 5 corners. A fill alone keeps its label, under 5 cells it
    becomes line.  Cells and areas are those at the start of a round, neighbours (side by side) those of the moment.
    """
    out = fill.copy()
    for _ in range(rounds):
        order = np.argsort(out, axis=None, kind="stable")
        labels, first = np.unique(out.ravel()[order], return_index=True)
        for label, at in zip(labels.tolist(), np.split(order, first[1:])):
            if label == 0 or len(at) >= 500:
                continue
            y, x = np.divmod(at, out.shape[1])
            top, left = y.min(), x.min()
            mask = np.zeros((y.max() - top + 3, x.max() - left + 3), bool)
            mask[y - top + 1, x - left + 1] = True
            rim = mask.copy()
            rim[1:] |= mask[:-1]
            rim[:-1] |= mask[1:]
            rim[:, 1:] |= mask[:, :-1]
            rim[:, :-1] |= mask[:, 1:]
            ry, rx = np.nonzero(rim & ~mask)
            ry, rx = ry + top - 1, rx + left - 1
            inside = (ry >= 0) & (rx >= 0) & (ry < out.shape[0]) & (rx < out.shape[1])
            near = np.unique(out[ry[inside], rx[inside]])
            near = near[near != 0]
            to = near[0] if len(near) else 0 if len(at) < 5 else label
            if len(at) < 50 or (len(at) < 250 and len(near) == 1) or corners(outline(mask)) <= 5:
                out[y, x] = to
        if len(np.unique(out)) == len(labels):
            break
    return out


def spread(colors: np.ndarray, fixed: np.ndarray, steps: int = 40, pace: float = 0.003, decay: float = 0.99) -> np.ndarray:
    """Colours (0..255, one a row) after ``steps`` - 1 moves away from their nearest neighbour; black is an unmoved neighbour, ``fixed`` ones stay.

    All move at once, into 0.1..0.9 of the range; the pace decays. Equal colours move along a direction that their place decides.
    """
    start = np.vstack([colors / 255.0, np.zeros(colors.shape[1])])
    held, now = np.append(fixed.astype(bool), True), start.copy()
    for _ in range(steps - 1):
        gap = now[:, None, :] - now[None, :, :]
        far = np.sqrt((gap * gap).sum(2))
        np.fill_diagonal(far, np.inf)
        near = far.argmin(1)
        way, long = gap[np.arange(len(now)), near], far[np.arange(len(now)), near]
        for k in np.flatnonzero(long < 0.0001):
            way[k] = np.random.default_rng(k).standard_normal(now.shape[1])
            long[k] = np.sqrt((way[k] ** 2).sum())
        moved = np.clip(now + pace * way / long[:, None], 0.1, 0.9)
        now = np.where(held[:, None], start, moved)
        pace *= decay
    return np.round(255 * now[:-1]).astype(int)


def spread_colors(colors: DataFrame) -> DataFrame:
    """(frame, k, rgb, fixed) -> (frame, k, rgb) with the colours of each frame spread; a frame has about a hundred colours."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(np.argsort(rows["k"].to_numpy(), kind="stable"))
        out = spread(np.array(rows["rgb"].to_pylist(), float), rows["fixed"].to_numpy(zero_copy_only=False))
        return pa.table({"frame": rows["frame"], "k": rows["k"], "rgb": pa.array(out.tolist(), pa.list_(pa.int64()))})

    return colors.groupBy("frame").applyInArrow(run, "frame long, k long, rgb array<long>")


def ssim_window(a: np.ndarray, b: np.ndarray, size: int = 11, sigma: float = 1.5) -> float:
    """Structural similarity with a Gaussian window, valid part, of two 8-bit channels."""
    x = np.arange(size) - size // 2
    g = np.exp(-x * x / (2 * sigma * sigma))
    g /= g.sum()

    def blur(m: np.ndarray) -> np.ndarray:
        rows = sum(w * m[k : m.shape[0] - size + 1 + k] for k, w in enumerate(g))
        return sum(w * rows[:, k : m.shape[1] - size + 1 + k] for k, w in enumerate(g))

    a, b = a.astype(np.float64), b.astype(np.float64)
    ma, mb = blur(a), blur(b)
    va, vb, c = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float(((2 * ma * mb + c1) * (2 * c + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def merge_frames(fills: DataFrame, rounds: int = 10) -> DataFrame:
    """(clip_id, frame_no, y, x, fill) -> the same, with small and simple fills merged; a frame is one group."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        fill = np.zeros((int(y.max()) + 1, int(x.max()) + 1), np.int64)
        fill[y, x] = rows["fill"].to_numpy()
        return rows.set_column(rows.schema.get_field_index("fill"), "fill", pa.array(merge_fills(fill, rounds)[y, x]))

    plain = fills.select("clip_id", "frame_no", "y", "x", "fill")
    return plain.groupBy("clip_id", "frame_no").applyInArrow(run, "clip_id string, frame_no int, y long, x long, fill long")


def fill_frames(pixels: DataFrame, radii: tuple[int, ...] = (4, 2, 1), keep: tuple[str, ...] | str = ("max", "mean", "mean")) -> DataFrame:
    """(clip_id, frame_no, y, x, line) -> (clip_id, frame_no, y, x, fill): 0 on lines."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        free = np.zeros((int(y.max()) + 1, int(x.max()) + 1), bool)
        free[y, x] = ~rows["line"].to_numpy(zero_copy_only=False).astype(bool)
        fill = trapped_ball(free, radii, keep)
        return pa.table({"clip_id": rows["clip_id"], "frame_no": rows["frame_no"], "y": rows["y"], "x": rows["x"], "fill": pa.array(fill[y, x])})

    return pixels.groupBy("clip_id", "frame_no").applyInArrow(run, "clip_id string, frame_no int, y long, x long, fill long")
