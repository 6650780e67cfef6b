"""Hashes of words and of all windows of a sequence, with whole columns of texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and BASE ** -k modulo 2 ** 64 for k up to n."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 20)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finalizer of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Sums of symbols times powers, from which every span's hash follows."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols))[0][: len(symbols)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the symbols from each start to each end; equal spans have equal ones wherever they lie."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def window_hash(sums: np.ndarray, length: int) -> np.ndarray:
    """span_hash of the window of ``length`` symbols at every place where one fits."""
    n = max(0, len(sums) - length)
    return mix((sums[length:] - sums[:n]) * powers(len(sums))[1][:n]) if n else np.zeros(0, np.uint64)


def tree_hash(symbols: np.ndarray, length: int) -> np.ndarray:
    """A hash of the window of ``length`` symbols at every place where one fits.

    Neighbours are joined to pairs, fours, eights and so on, and the binary digits of the
    length to a window. Each step mixes, so that sums over symbols, which regular or
    crafted sequences can make equal, play no part.
    """
    out, done, size, spans = None, 0, 1, symbols
    total = len(symbols) - length + 1
    if total <= 0:
        return symbols[:0]
    while True:
        if length & size:
            part = spans[done : done + total]
            out = part if out is None else mix(out * np.uint64(BASE) + part)
            done += size
        if 2 * size > length:
            return mix(out)
        spans = mix(spans[:-size] * np.uint64(0xD6E8FEB86659FD93) + spans[size:])
        size *= 2


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, short: int = 16) -> np.ndarray:
    """A hash of each word; long ones, on which sums of powers can be made to agree, by XXH3."""
    out = span_hash(prefix(BYTES[data]), starts, ends)
    long = np.flatnonzero(ends - starts > short)
    if len(long):
        from xxhash import xxh3_64_intdigest

        raw = data.tobytes()
        out[long] = np.fromiter((xxh3_64_intdigest(raw[i:j]) for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
    return out


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and where each text starts in them, the end last; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of at most ``size`` bytes together, or of one text that is longer."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and each text's first word, the number of words last."""
    n = len(data)
    inside = ~SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def bit_counts(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the hashes of each span have each of the 64 bits set, lowest bit first.

    Bits are added in eight lanes of a byte each, 255 hashes at most, then over lanes.
    """
    out = np.zeros((len(starts), 64), np.int64)
    full = np.flatnonzero(ends > starts)
    if not len(full):
        return out
    size = (ends - starts)[full]
    pieces = -(-size // 255)
    first = np.cumsum(pieces) - pieces
    begin = np.repeat(starts[full], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    stop = np.minimum(begin + 255, np.repeat(ends[full], pieces))
    edges = np.stack([begin, stop], 1).ravel()
    h = np.append(h, np.uint64(0))  # so that an end may be the last place
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & np.uint64(0x0101010101010101), edges)[::2]
        out[full, j::8] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out


def majority(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """64-bit numbers with the bits that over half of the hashes have."""
    bits = (2 * counts > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
