"""Column-wise construction of the Burrows-Wheeler transform of a collection
of strings, with the common prefixes of neighbouring suffixes.

Each round puts one more symbol of every string in front of its suffix: the
rank of the symbol in the transform gives the new suffix's place, and the
least common prefix between it and the nearest places with the same symbol
gives its common prefixes. The transform and the prefixes live in files that
each round reads and writes once from front to back.
"""

from __future__ import annotations

import tempfile

import numpy as np


class _File:
    """An array in a temporary file, rewritten as a whole each round."""

    def __init__(self, size: int, dtype):
        self.maps = [np.memmap(tempfile.TemporaryFile(), dtype, "w+", shape=max(size, 1)) for _ in range(2)]
        self.n = 0

    def read(self) -> np.ndarray:
        return self.maps[0][:self.n]

    def insert(self, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Write the next version: ``values`` at ``places``, the rest around."""
        old, self.n = self.maps[0][:self.n], self.n + len(places)
        new = self.maps[1][:self.n]
        stay = np.ones(self.n, bool)
        stay[places] = False
        new[stay], new[places] = old, values
        self.maps.reverse()
        return new


def range_min(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of a[low..high] (both included) for each pair."""
    if not len(low):
        return np.empty(0, a.dtype)
    order = np.argsort(low, kind="stable")
    cuts = np.stack([low[order], high[order] + 1], 1).ravel()
    out = np.empty(len(low), a.dtype)
    out[order] = np.minimum.reduceat(np.append(a, a[:1]), cuts)[::2]
    return out


def sorted_tails(tails: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The order of (symbol, bytes) pairs and what each has in common with the one before it."""
    by = np.array(sorted(range(len(tails)), key=tails.__getitem__), np.int64)
    kind, size = np.array([t[0] for t in tails])[by], np.array([len(t[1]) for t in tails])[by]
    width = int(size.max()) + 1
    rows = np.frombuffer(b"".join([tails[i][1].ljust(width, b"\0") for i in by.tolist()]), np.uint8).reshape(-1, width)
    differ = rows[1:] != rows[:-1]
    common = np.zeros(len(by), np.int16)
    common[1:] = np.minimum(np.where(differ.any(1), differ.argmax(1), width), np.minimum(size[1:], size[:-1])) + 1
    common[1:][kind[1:] != kind[:-1]] = 0
    return by, common


def shared(strings: list[np.ndarray], least: int, tails: list[tuple[int, bytes]] | None = None) -> list[np.ndarray]:
    """For each string of symbols (uint16, above 0) the places whose next
    ``least`` symbols occur at another place of the collection too.

    With ``tails`` each string goes on with a symbol of its own kind, that no
    string holds, and some bytes. No place behind that symbol is asked for, so
    the rounds begin with the sorted tails and not with empty suffixes."""
    m = len(strings)
    length = np.array([len(s) for s in strings])
    stop = np.zeros(1, np.uint16)  # one place for each tail
    flat, ends = np.concatenate([x for s in strings for x in (s, stop)]), np.cumsum(length + 1) - 1
    total = len(flat)
    bwt, lcp = _File(total, np.uint16), _File(total, np.int16)
    by, common = sorted_tails(tails) if tails is not None else (np.arange(m), np.zeros(m, np.int16))
    first, ids = np.arange(m), np.arange(m)
    last = lambda t, j: np.where(j < length[t], flat[np.maximum(ends[t] - j - 1, 0)], 0).astype(np.uint16)
    bwt.insert(first, last(by, 0))  # the tails
    lcp.insert(first, common)
    place = np.empty(m, np.int64)  # of each string's latest suffix
    place[by] = first
    where = _File(total, np.int32)  # which suffix stands at a place
    start = ends - length
    where.insert(first, ends[by].astype(np.int32))
    for j in range(1, int(length.max(initial=0)) + 1):
        ids = ids[length[ids] >= j]
        b, common = bwt.read(), lcp.read()
        order = np.argsort(b, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        p = place[ids]
        r, ended = rank[p], int(np.searchsorted(b[order], 1))
        new = m + r - ended
        # neighbours with the same symbol in front
        before, after = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, len(order) - 1)]
        same_b, same_a = (r > 0) & (b[before] == b[p]), (r + 1 < len(order)) & (b[after] == b[p])
        up, down = np.zeros(len(ids), np.int16), np.zeros(len(ids), np.int16)
        up[same_b] = range_min(common, before[same_b] + 1, p[same_b]) + 1
        down[same_a] = range_min(common, p[same_a] + 1, after[same_a]) + 1
        bwt.insert(new, last(ids, np.full(len(ids), j)))
        after_insert = lcp.insert(new, up)
        inside = new + 1 < len(after_insert)
        after_insert[new[inside] + 1] = down[inside]
        where.insert(new, (ends[ids] - j).astype(np.int32))
        place[ids] = new
    common, at = np.asarray(lcp.read()), np.asarray(where.read())
    again = common >= least
    again[:-1] |= common[1:] >= least
    hits = np.sort(at[again])
    cut = np.searchsorted(hits, np.append(start, total))
    return [hits[cut[t]:cut[t + 1]] - start[t] for t in range(m)]
