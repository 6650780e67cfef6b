"""A count-min sketch of hashes over a whole table, and the windows it is asked about.

Each task sketches what it reads (cells with counts), the sketches of all tasks are
merged by ranges of cells, and a hash whose every cell holds 2 or more may be
repeated: counts are never too small, so no repeated hash is missed.

Cells that hold 2 or more are sent to all tasks as one bit each, neighbouring cells
sharing one, which lets more pass and loses none. There is about a bit for every hash,
at least 2 ** 27 and at most 2 ** 30 for each of ``DEPTH`` rows: 32 to 256 MB are
broadcast. That is the proven bound; beyond about 70 GB of text the sketch is full,
lets more pass, and the exact second pass has more to shuffle.

Not every window is counted. Windows are grouped by their anchor: the block of
``block`` symbols with the least hash among those within the window. Windows that
are equal have equal anchors at the same distance, so a window occurs at most as
often as its anchor, and neighbouring windows mostly share theirs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import mix, window_hash

DEPTH = 2
CELL_BITS = 32
FOLD_BITS = (27, 30)
#: About so many bytes of text have one anchor.
BYTES_PER_HASH = 64
PLACE_BITS = np.uint64(28)
#: So many windows are ranked at once.
SEGMENT = 1 << 27
_SEEDS = [np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)]


def cells(hashes: np.ndarray, row: int) -> np.ndarray:
    return (mix(hashes ^ _SEEDS[row]) >> np.uint64(64 - CELL_BITS)).astype(np.uint32)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of v[s : s + width] for every s where that fits."""
    n = len(v) - width + 1
    if n <= 0:
        return v[:0]
    blocks = -(-len(v) // width)
    padded = np.full(blocks * width, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def least_places(hashes: np.ndarray, width: int, segment: int = SEGMENT) -> np.ndarray:
    """The place of the least, and of equal ones the first, of hashes[s : s + width] for every s where that fits."""
    n = max(0, len(hashes) - width + 1)
    out = np.empty(n, np.int64)
    for at in range(0, n, segment):
        part = hashes[at : min(at + segment, n) + width - 1]
        # The place is in the low bits.
        ranked = (part >> PLACE_BITS << PLACE_BITS) | np.arange(len(part), dtype=np.uint64)
        out[at : at + segment] = at + (sliding_min(ranked, width) & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
    return out


class Runs:
    """Runs of neighbouring windows with one anchor, over several sequences in a row.

    ``low`` to ``high``: the windows' starts; ``anchor``: the anchor's start;
    ``hash``: the anchor's hash; ``owner``: which sequence.
    """

    def __init__(self, sums: np.ndarray, bounds: np.ndarray, length: int, block: int):
        sizes = np.diff(bounds)
        windows = np.maximum(sizes - length + 1, 0)
        first = np.cumsum(windows) - windows
        starts = np.repeat(bounds[:-1] - first, windows) + np.arange(windows.sum())
        if not len(starts):
            self.low = self.high = self.anchor = self.owner = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        hashes = window_hash(sums, block)
        anchor = least_places(hashes, length - block + 1)[starts]
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))
        begin = np.flatnonzero(new)
        self.low, self.high = starts[begin], starts[np.append(begin[1:], len(starts)) - 1]
        self.anchor, self.hash = anchor[begin], hashes[anchor[begin]]
        self.owner = np.searchsorted(bounds, self.low, "right") - 1


class Repeated:
    """Which hashes may occur twice or more."""

    def __init__(self, bits: list[np.ndarray], fold: int):
        self.bits, self.fold = bits, fold

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for row, bits in enumerate(self.bits):
            at = cells(hashes, row) >> np.uint32(CELL_BITS - self.fold)
            out &= (bits[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
        return out


def merge_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[new], np.minimum(np.add.reduceat(counts, new), 255).astype(np.uint8)


def packed(cells: np.ndarray) -> bytes:
    """Ascending cells as differences, byte planes apart and compressed."""
    steps = np.diff(cells, prepend=np.uint32(0)).astype("<u4")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def fold_bits(n_bytes: int) -> int:
    """How many bits number the bits of a row, for a text of so many bytes."""
    return min(FOLD_BITS[1], max(FOLD_BITS[0], (n_bytes // BYTES_PER_HASH).bit_length()))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def repeated(docs: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], n_bytes: int, hold: int = 2_000_000) -> Repeated:
    """Sketches ``hashes_of`` every batch of texts of about ``n_bytes`` in all. One bit of each cell comes to the driver."""
    fold = fold_bits(n_bytes)
    shard_bits = min(16, max(6, docs.rdd.getNumPartitions().bit_length()))

    def local(batches):
        kept = [(np.zeros(0, np.uint32), np.zeros(0, np.uint8)) for _ in range(DEPTH)]
        held: list[np.ndarray] = []

        def close():
            nonlocal held
            hashes = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held = []
            for row in range(DEPTH):
                found = cells(hashes, row)
                if len(found) + len(kept[row][0]):
                    kept[row] = merge_counts(np.concatenate([kept[row][0], found]), np.concatenate([kept[row][1], np.ones(len(found), np.uint8)]))

        for batch in batches:
            held.append(hashes_of(batch))
            if sum(map(len, held)) > hold:
                close()
        close()
        for row, (keys, counts) in enumerate(kept):
            edges = np.searchsorted(keys, np.arange((1 << shard_bits) + 1, dtype=np.uint64) << np.uint64(CELL_BITS - shard_bits))
            shards = [k for k in range(1 << shard_bits) if edges[k + 1] > edges[k]]
            if shards:
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([row << shard_bits | k for k in shards], pa.int32()),
                    "cells": pa.array([packed(keys[edges[k] : edges[k + 1]]) for k in shards], pa.binary()),
                    "counts": pa.array([zlib.compress(counts[edges[k] : edges[k + 1]].tobytes(), 1) for k in shards], pa.binary()),
                })

    def merged(key, table):
        # One range of cells of all tasks; the number of ranges grows with the number of tasks.
        counts = b"".join(zlib.decompress(x) for x in table.column("counts").to_pylist())
        keys, counts = merge_counts(np.concatenate([unpacked(x) for x in table.column("cells").to_pylist()]), np.frombuffer(counts, np.uint8))
        shard = key[0].as_py()
        base = (shard & ((1 << shard_bits) - 1)) << (fold - shard_bits)
        bits = np.zeros(1 << (fold - shard_bits), np.uint8)
        bits[(keys[counts > 1] >> np.uint32(CELL_BITS - fold)).astype(np.int64) - base] = 1
        packed = zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)
        return pa.table({"shard": pa.array([shard], pa.int32()), "bits": pa.array([packed], pa.binary())})

    rows = docs.mapInArrow(local, "shard int, cells binary, counts binary").groupBy("shard").applyInArrow(merged, "shard int, bits binary").collect()
    bits = [np.zeros(1 << fold >> 3, np.uint8) for _ in range(DEPTH)]
    size = 1 << (fold - shard_bits) >> 3
    for r in rows:
        row, at = r["shard"] >> shard_bits, (r["shard"] & ((1 << shard_bits) - 1)) * size
        bits[row][at : at + size] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return Repeated(bits, fold)
