"""Shingle sets and fast similarity sketches of texts, as numpy arrays."""

from __future__ import annotations

import numpy as np

from .textarrays import BLANK_BYTES, lowered, mix64, span_hashes, table64, word_spans

#: Words of a shingle.
SHINGLE = 5


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, words: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes.

    Letters A-Z count as lower case, words are runs without blanks. A text of
    fewer words than a shingle has is one shingle; one without words has none.
    """
    starts, ends, bounds = word_spans(flat, offsets, BLANK_BYTES)
    hashes = span_hashes(lowered(flat), starts, ends, salt=3)
    factors = table64(words, 7) | np.uint64(1)
    n = max(0, len(hashes) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled += hashes[k : k + n] * factors[k]
    rolled = mix64(rolled)
    found = []
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if last - first >= words:
            found.append(np.unique(rolled[first : last - words + 1]))
        elif last > first:
            short = (hashes[first:last] * factors[: last - first]).sum(dtype=np.uint64) + np.uint64(last - first)
            found.append(mix64(np.array([short])))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def set_digests(sets: list[np.ndarray]) -> list[bytes]:
    """Sixteen bytes for each set, equal for equal sets."""
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(flat ^ salt), dtype=np.uint64)]) for salt in table64(2, 11)]
    ends = np.cumsum(sizes)
    pairs = np.stack([mix64(s[ends] - s[ends - sizes] + sizes.astype(np.uint64)) for s in sums], axis=1)
    return [x.tobytes() for x in pairs]


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Fast similarity sketches [set, bin] of non-empty sets.

    In round i < bins every element falls into a hashed bin with the value
    (i, hash); in round bins + j every element falls into bin j. A bin keeps
    its least value, so the first round that reaches it decides. A set leaves
    when all its bins are full, which 2 * bins rounds guarantee; large sets
    need about one. Two sets agree in a bin with the probability of their
    Jaccard similarity, and the share of bins that agree is concentrated as
    if bins were independent samples.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    found = np.full(len(sets) * bins, np.iinfo(np.uint64).max, np.uint64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    row = np.repeat(np.arange(len(sets)), sizes)
    salts = table64(2 * bins, 13)
    low = np.uint64((1 << 48) - 1)
    for i in range(2 * bins):
        value = mix64(flat ^ salts[i])
        place = ((value >> np.uint64(48)) % np.uint64(bins)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(found, row * bins + place, (value & low) | np.uint64(i << 48))
        open_rows = (found.reshape(-1, bins) == np.iinfo(np.uint64).max).any(axis=1)
        stay = open_rows[row]
        if not stay.any():
            break
        flat, row = flat[stay], row[stay]
    return found.reshape(-1, bins)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key [set, band] from each stretch of `rows` bins."""
    factors = table64(rows, 17) | np.uint64(1)
    parts = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    return mix64((parts * factors).sum(axis=2, dtype=np.uint64) + table64(bands, 19)).view(np.int64)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Members that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
