"""A count-min sketch that answers one question: may this key occur twice?

Every task sketches its own keys: for each of ``rows`` hash rows the sorted
cells, gap-coded (a cell at most twice, as counts stop at two). The partial
sketches are merged cell range by cell range with saturating addition; the
cells that reached two come back as bit maps of ``2**bits`` bits a row, so
the driver and each worker hold ``rows * 2**bits / 8`` bytes whatever the
input. Estimates are never too low: a key seen twice always answers yes.
Beyond the sketch's width more keys answer yes, which costs the exact pass
that follows time, never results; ``fitting`` chooses a width, and which
share of many keys to sketch so that the others do not fill it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BITS, ROWS, RANGES = 28, 2, 64
#: The widest sketch that ``fitting`` chooses: 256 MB in a worker.
MOST_BITS = 30
#: Bytes of a bit map that are sent as one piece.
PIECE = 4 << 20


def fitting(keys: int, wanted: float, bits: int | None = None) -> tuple[int, float]:
    """(bits, share): a sketch of that share of ``keys`` distinct keys tells
    the most of them to be unique; the least width (if ``bits`` doesn't give
    it) for which these are half as many again as the ``wanted`` share of all."""
    for bits in [bits] if bits else range(BITS, MOST_BITS + 1):
        load = keys / 2 ** bits
        share = min(1.0, 1.2 / load) if load else 1.0  # the best load of a cell is 1.2 keys
        if share * (1 - (1 - math.exp(-share * load)) ** ROWS) >= 1.5 * wanted:
            break
    return bits, share


def sketched(keys: np.ndarray, share: float) -> np.ndarray:
    """Which keys are in the sketched share, by their lower bits."""
    return (keys & np.uint64(0xFFFFFFFF)) < np.uint64(math.ceil(share * 2 ** 32))


def cells(keys: np.ndarray, row: int, bits: int = BITS) -> np.ndarray:
    """Cell of each 64-bit key in a row: upper or lower bits of the key."""
    if row == 0:
        return keys >> np.uint64(64 - bits)
    return (keys * np.uint64(0x9E3779B97F4A7C15 + 2 * row) & np.uint64(2 ** 64 - 1)) >> np.uint64(64 - bits)


def pack(sorted_cells: np.ndarray) -> bytes:
    """Gaps of a sorted run as bytes; 255 means 255 more to come."""
    gaps = np.diff(sorted_cells.astype(np.int64), prepend=0)
    ends = np.cumsum(gaps // 255 + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = gaps % 255
    return out.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    b = np.frombuffer(blob, np.uint8)
    return np.cumsum(b, dtype=np.int64)[b < 255]


def partial(keys: np.ndarray, bits: int, rows: int, ranges: int) -> pd.DataFrame:
    """The sketch of some keys: (slot, blob) for each row and cell range."""
    out, shift = [], bits - (ranges - 1).bit_length()
    for row in range(rows):
        c = np.sort(cells(keys, row, bits))
        keep = np.ones(len(c), bool)
        keep[2:] = c[2:] != c[:-2]  # counts stop at two
        c = c[keep]
        cuts = np.searchsorted(c, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(shift))
        for r in range(ranges):
            if cuts[r] < cuts[r + 1]:
                out.append((row * ranges + r, pack(c[cuts[r]:cuts[r + 1]] - np.uint64(r << shift))))
    return pd.DataFrame(out, columns=["slot", "blob"])


class Repeated:
    """Bit maps of the cells with a count of two or more."""

    def __init__(self, maps: np.ndarray, bits: int):
        self.maps, self.bits = maps, bits

    def __getstate__(self):
        """Sent compressed: few cells are set where keys seldom repeat; in
        pieces, so that neither side holds a second copy of the whole."""
        flat = self.maps.reshape(-1)
        return self.bits, self.maps.shape, [zlib.compress(flat[k:k + PIECE].tobytes(), 1) for k in range(0, len(flat), PIECE)]

    def __setstate__(self, state):
        self.bits, shape, pieces = state
        self.maps = np.empty(shape, np.uint8)
        flat, at = self.maps.reshape(-1), 0
        while pieces:
            piece = np.frombuffer(zlib.decompress(pieces.pop(0)), np.uint8)
            flat[at:at + len(piece)] = piece
            at += len(piece)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        yes = np.ones(len(keys), bool)
        for row in range(len(self.maps)):
            c = cells(keys, row, self.bits)
            yes &= (self.maps[row][c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return yes


def repeated(source: DataFrame, keys_of: Callable[[pd.DataFrame], np.ndarray], bits: int = BITS, rows: int = ROWS,
             ranges: int = RANGES, flush: int = 3_000_000):
    """Broadcast variable of a ``Repeated`` over the keys of ``source``;
    ``keys_of`` gives the uint64 keys of a batch of rows. A task holds at
    most ``flush`` keys besides one batch."""
    spark = source.sparkSession

    def sketch(batches: Iterator[pd.DataFrame]):
        held, n = [], 0
        for b in batches:
            held.append(keys_of(b))
            n += len(held[-1])
            if n >= flush:
                yield partial(np.concatenate(held), bits, rows, ranges)
                held, n = [], 0
        if n:
            yield partial(np.concatenate(held), bits, rows, ranges)

    size = 2 ** bits // ranges

    def merge(batches: Iterator[pd.DataFrame]):
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for slot, blob in zip(b["slot"], b["blob"]):
                once, twice = seen.setdefault(slot, (np.zeros(size, bool), np.zeros(size, bool)))
                c = unpack(blob)
                twice[c[1:][c[1:] == c[:-1]]] = True
                twice[c[once[c]]] = True
                once[c] = True
        for slot, (_, twice) in seen.items():
            yield pd.DataFrame({"slot": [slot], "blob": [np.packbits(twice, bitorder="little").tobytes()]})

    parts = source.mapInPandas(sketch, "slot int, blob binary")
    merged = parts.repartition(rows * ranges // 4, "slot").mapInPandas(merge, "slot int, blob binary")
    maps = np.zeros((rows, 2 ** bits // 8), np.uint8)
    for r in merged.toLocalIterator():  # rows * 2**bits / 8 bytes in all
        row, part = divmod(r["slot"], ranges)
        maps[row, part * size // 8:(part + 1) * size // 8] = np.frombuffer(r["blob"], np.uint8)
    return spark.sparkContext.broadcast(Repeated(maps, bits))
