"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of many short strings.

One symbol of every string is inserted per round, from the right.  The transform, the common-prefix lengths of
neighbouring suffixes and the suffixes' names live in files; a round reads them once from front to back and writes
the files of the next round.  The suffix that symbol c makes out of the suffix at rank p has the place that the c at p has among all
symbols sorted stably, and its common prefix with the neighbour of the same symbol is one more than the
least common prefix between the two ranks.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np


class _Files:
    """The three sequential files of a round; those of the next round are written beside them, in turns."""

    KINDS = {"bwt": np.int16, "lcp": np.uint8, "names": np.int32}

    def __init__(self, folder: str):
        self.folder, self.turn, self.size = folder, 0, 0

    def _path(self, kind: str) -> str:
        return os.path.join(self.folder, f"{kind}.{self.turn}")

    def read(self) -> list[np.ndarray]:
        return [np.fromfile(self._path(k), t, self.size) for k, t in self.KINDS.items()]

    def write(self, *arrays: np.ndarray) -> None:
        self.turn, self.size = 1 - self.turn, len(arrays[0])
        for (k, t), a in zip(self.KINDS.items(), arrays):
            with open(os.open(self._path(k), os.O_WRONLY | os.O_CREAT), "wb", closefd=True) as f:
                f.write(np.ascontiguousarray(a, t).data)


def suffixes(strings: list[bytes], depth: int = 255) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, lcp) of all suffixes in sorted order, the empty ones first; lcp with the suffix before, up to ``depth`` (255 at most).

    Equal suffixes of different strings stand in the order of the strings.
    """
    m = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    longest = int(sizes.max(initial=0))
    right = np.full((m, longest + 1), -1, np.int16)  # column j: the symbol that stands j before the end
    for i, s in enumerate(strings):
        right[i, : len(s)] = np.frombuffer(s, np.uint8)[::-1]
    ends = np.zeros(m, np.uint8)
    with tempfile.TemporaryDirectory() as folder:
        files = _Files(folder)
        files.write(right[:, 0], ends, np.arange(m) * (longest + 1))
        place = np.arange(m)  # rank of each string's latest suffix
        for j in range(1, longest + 1):
            bwt, lcp, names = files.read()
            active = sizes >= j
            fresh = np.full(len(bwt), -1, np.int32)
            fresh[place[active]] = np.flatnonzero(active)
            order = np.argsort(bwt, kind="stable")
            order = order[np.searchsorted(bwt[order], 0) :]  # ends of strings lead to no suffix
            who = fresh[order]
            new = who >= 0
            symbol = bwt[order]
            size = m + len(order)
            tail = slice(m, size)
            n_bwt, n_lcp, n_names = np.empty(size, np.int16), np.zeros(size, np.uint8), np.empty(size, np.int32)
            n_bwt[:m], n_names[:m] = bwt[:m], names[:m]
            old = ~new
            n_bwt[tail][old], n_names[tail][old], n_lcp[tail][old] = bwt[m:], names[m:], lcp[m:]
            strings_in = who[new]
            n_bwt[tail][new] = right[strings_in, j]
            n_names[tail][new] = strings_in * (longest + 1) + j
            # Common prefixes change at the new suffixes and right behind them.
            at = np.flatnonzero(new)
            change = np.zeros(len(order) + 1, bool)
            change[at] = change[at + 1] = True
            touched = np.flatnonzero(change[:-1])[::-1]  # downwards: reduceat then reads only within pairs
            before = touched - 1
            same = (before >= 0) & (symbol[np.maximum(before, 0)] == symbol[touched])
            value = np.zeros(len(touched), np.int64)
            if same.any():
                lo, hi = order[before[same]] + 1, order[touched[same]] + 1
                bounds = np.empty(2 * len(lo), np.int64)
                bounds[0::2], bounds[1::2] = lo, hi
                least = np.minimum.reduceat(np.append(lcp, np.uint8(0)), bounds)[0::2]
                value[same] = np.minimum(least.astype(np.int64) + 1, depth)
            n_lcp[tail][touched] = value
            place[strings_in] = m + at
            files.write(n_bwt, n_lcp, n_names)
        _, lcp, names = files.read()
    names = names.astype(np.int64)
    string, after = names // (longest + 1), names % (longest + 1)
    return string, sizes[string] - after, lcp
