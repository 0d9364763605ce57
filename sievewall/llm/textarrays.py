"""Texts of an Arrow batch as flat numpy arrays: bytes, word spans, word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def table64(n: int, salt: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 32)) * np.uint64(0x9E3779B97F4A7C15))


def byte_class(members: bytes) -> np.ndarray:
    """A lookup table of 256 booleans."""
    found = np.zeros(256, bool)
    found[np.frombuffer(members, np.uint8)] = True
    return found


#: [\x20\x09-\x0D]
BLANK_BYTES = byte_class(b" \t\n\x0b\x0c\r")


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end and the n + 1 offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def lowered(flat: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((flat >= 65) & (flat <= 90), flat + np.uint8(32), flat)


def word_spans(flat: np.ndarray, offsets: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs without gap bytes, and where each row's words begin (n + 1 bounds)."""
    inside = ~gaps[flat]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    begins = edges[edges < len(flat)]
    first[begins] = inside[begins]
    ends_before = edges[edges > 0] - 1
    last[ends_before] = inside[ends_before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_sums(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums, wrapping at 64 bits, of each span's bytes times powers of their place; where each span begins in them."""
    sizes = ends - starts
    begin = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(begin, sizes)
    powers = np.full(int(sizes.max()), 0xD6E8FEB86659FD93, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    values = table64(256, salt)[flat[place + np.repeat(starts, sizes)]] * powers[place]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)]), begin


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 1) -> np.ndarray:
    """A 64-bit polynomial hash of each span, mixed with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums, begin = span_sums(flat, starts, ends, salt)
    return _hash(sums, begin, ends - starts)


def prefix_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...], salt: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, which spans are longer and the hashes of their first bytes; then all spans and their hashes."""
    if not len(starts):
        return [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    sums, begin = span_sums(flat, starts, ends, salt)
    found = []
    for length in lengths:
        longer = np.flatnonzero(ends - starts > length)
        found.append((longer, _hash(sums, begin[longer], np.full(len(longer), length))))
    return [*found, (np.arange(len(starts)), _hash(sums, begin, ends - starts))]


def _hash(sums: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mix64(sums[begin + sizes] - sums[begin] + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, end to end."""
    begin = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum()), dtype=np.int64) + np.repeat(starts - begin, sizes)
